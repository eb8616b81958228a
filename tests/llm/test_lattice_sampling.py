import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigram.llm import lattice_sampling as ls
from lexigram.llm.common import text_buffer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ls.pieces_of(MODEL)
BY_BYTES = {}
for _i, _b in enumerate(PIECES.bytes_of):
    if _b and _i not in set(PIECES.byte_id.tolist()):
        BY_BYTES[_b] = _i


def sampled(texts, keys=None, pieces=PIECES):
    keys = np.arange(len(texts), dtype=np.uint64) if keys is None else np.array(keys, np.uint64)
    ids, counts = ls.encode_texts(pieces, *text_buffer(pa.array(texts, pa.string())), keys)
    return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def paths(text):
    """Every segmentation of a text and its weight, by trying every edge."""
    raw = text.encode()

    def edges(i):
        for k in range(1, len(raw) - i + 1):
            if raw[i : i + k] in BY_BYTES:
                yield BY_BYTES[raw[i : i + k]], k
        j = i
        while raw[j] & 0xC0 == 0x80:
            j -= 1
        width = next(w for w in (1, 2, 3, 4) if j + w == len(raw) or raw[j + w] & 0xC0 != 0x80)
        if raw[j : j + width] not in BY_BYTES:
            yield int(PIECES.byte_id[raw[i]]), 1

    def walk(i):
        if i == len(raw):
            yield (), 0.0
            return
        for piece, k in edges(i):
            for rest, w in walk(i + k):
                yield (piece, *rest), w + PIECES.weight[piece]

    return dict(walk(0))


def test_samples_follow_the_exact_posterior():
    for text in (" there", "é日x", " \U0001f600a", "▁a", "     the"):
        want = paths(text)
        total = sum(map(math.exp, want.values()))
        n = 20000
        got = Counter(tuple(s.tolist()) for s in sampled([text] * n, range(1000, 1000 + n)))
        assert set(got) <= set(want)
        for path, w in want.items():
            p = math.exp(w) / total
            assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4, (text, path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_lossless(texts):
    got = sampled(texts)
    ids = np.concatenate(got) if got else np.zeros(0, np.int32)
    back = ls.decode_ids(PIECES, ids, np.array([len(g) for g in got], np.int64)) if got else []
    assert [b.decode() for b in back] == texts


def test_independent_of_other_rows_and_long_units():
    texts = ["the river  runs\n\n on", "", "x" * 20000 + "é" * 3000, "日本" * 2000, "a b", "the river  runs\n\n on"]
    whole = sampled(texts, [5, 1, 2, 3, 4, 5])
    for i, t in enumerate(texts):
        assert sampled([t], [[5, 1, 2, 3, 4, 5][i]])[0].tolist() == whole[i].tolist()
    assert whole[0].tolist() == whole[5].tolist()
    assert len({tuple(s.tolist()) for s in sampled([texts[0]] * 50)}) > 3


def test_frame_round_trip(spark):
    texts = [None, "", "plain words here", "▁ literal mark ▁", "\x00\t\r\n ", "é " * 30000, "same", "same"]
    rows = [(i if i < 6 else 6, t, "c") for i, t in enumerate(texts)] + [(None, "null id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = ls.encode(df, MODEL)
    back = ls.decode(made, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert all(r["lossless"] for r in made.collect())
    key = lambda r: (str(r["doc_id"]), list(r["ids"]))
    assert sorted(map(key, made.collect())) == sorted(map(key, ls.encode(df.repartition(3), MODEL).collect()))
    assert ls.encode(df.limit(0), MODEL).collect() == []
    assert sorted(map(key, ls.encode(df, MODEL, seed=1).collect())) != sorted(map(key, made.collect()))


def test_long_units_are_sampled_whole(monkeypatch):
    text = "the" * 3000
    bounds = [set(np.cumsum(PIECES.size[s]).tolist()) for s in sampled([text] * 30)]
    for at in (4096, 8192):
        assert any(at not in b for b in bounds)
    wide = "x" * 70000 + "é"
    got = sampled([wide])[0]
    assert ls.decode_ids(PIECES, got, np.array([len(got)])) == [wide.encode()]
    monkeypatch.setattr(ls, "UNIT_BYTES", 2)
    test_samples_follow_the_exact_posterior()
