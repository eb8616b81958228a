import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lexigram.llm import token_binary as tb
from lexigram.llm.common import text_buffer

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    """The library with quotes of added tokens as characters, which the encoder has unless ``added_tokens`` is set."""
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    packed = tb.EliasFano.pack(np.array(values, np.uint64))
    ef = tb.EliasFano(b"xyz" + packed, 3)
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    assert ef.end == 3 + len(packed)


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50000)).astype(np.uint64)
    bits = 8 * len(tb.EliasFano.pack(ends)) / len(ends)
    assert bits < 2.6 + np.log2(float(ends[-1]) / len(ends))


TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \nb", "a\n\nb", "it's they'll. x'd, y.", "word. word, word.. 3. 3, a1. é. é,", "<|endoftext|> x<|endoftext|>",
    "tab\tb \t c", "nbsp\xa0b \xa0c\xa0 d", "a\x1cb \x1c c", "... ,,, .a ,b", "ñ.\nŁ, x", "日本 語.\n\U0001f600.", "x" * 9000, "a\r\nb", "Don't.\nWon't,", "²., ½. Ⅷ,", "é. x́, y",
]


def test_encoder_equals_the_library():
    whole = plain()
    for keep in (3_000_000, 5):
        e = tb.Encoder(VOCAB, keep)
        ids, counts = e.encode(*text_buffer(pa.array(TEXTS)), 2)
        want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in TEXTS]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab.,' \n\té1-́²")), max_size=25))
def test_encoder_on_odd_strings(text):
    e = tb._encoder(VOCAB)
    assert e.encode(*text_buffer(pa.array([text])), None)[0].tolist() == plain_once().encode(text, add_special_tokens=False).ids


_plain = []


def plain_once():
    if not _plain:
        _plain.append(plain())
    return _plain[0]


def test_files_read_back(spark, tmp_path):
    rows = [(i * 7 - 20, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, None, "x"), (None, "b", "x"), (1, "twice", "x"), (1, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    tb.write(df, VOCAB, f"{tmp_path}/t", image_ids=50)
    got = tb.read(spark, f"{tmp_path}/t").collect()
    want, start = [], 0
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""])):
        ids = plain_once().encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_image_documents():
    image = tb.Image(tb.write_image(np.array([5, 70000, 2, 2]), np.array([3, 1]), [-4, 9]))
    assert image.doc(0).tolist() == [5, 70000, 2] and image.doc(1).tolist() == [2] and image.doc_ids() == [-4, 9]
    with pytest.raises(ValueError):
        tb.Image(b"\0" * 40)


def test_empty_table(spark, tmp_path):
    tb.write(spark.createDataFrame([], "doc_id long, text string"), VOCAB, f"{tmp_path}/t")
    assert tb.read(spark, f"{tmp_path}/t").collect() == []


def test_query_encodes_quoted_tokens_as_the_library_does(spark, tmp_path):
    from lexigram.llm import queries

    texts = ["ab <|endoftext|> cd", "plain words", "<|endoftext|>", "x<|endoftext|><|endoftext|>.\ny", "<|endoftext", "|> a", "", "<|endoftext|> " + "w " * 3000, "end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole, start = Tokenizer.from_file(VOCAB), 0
    got = sorted(map(tuple, queries.op6_token_binary(spark, str(tmp_path)).collect()))
    assert whole.encode(texts[0], add_special_tokens=False).ids == [397, 220, 50256, 22927]
    for i, t in enumerate(texts):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_long_texts_that_quote_tokens(monkeypatch):
    whole = Tokenizer.from_file(VOCAB)
    monkeypatch.setattr(tb.bw, "LONG", 400)
    for text in ("some words " * 200 + "<|endoftext|> z", "some words " * 200):
        e = tb.Encoder(VOCAB, added_tokens=True)
        assert e.encode(*text_buffer(pa.array([text])), None)[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_are_integers_and_hot_ids_span_ranges(spark, tmp_path):
    with pytest.raises(TypeError):
        tb.images(spark.createDataFrame([("a", "b")], "doc_id string, text string"), VOCAB)
    df = spark.createDataFrame([(5, "same text")] * 400 + [(i, "x") for i in range(3)], "doc_id int, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tb.write(df, VOCAB, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/t").select("part").distinct().count() > 2
    got = sorted(map(tuple, tb.read(spark, f"{tmp_path}/t").select("start", "n_tokens", "doc_id").collect()))
    assert [g[0] for g in got[1:]] == [g[0] + g[1] for g in got[:-1]] and [g[2] for g in got] == [0, 1, 2, *[5] * 400]
