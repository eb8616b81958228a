"""Texts over the limit go piece by piece, with the same results."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lexigram.llm import bytewords as bw
from lexigram.llm import cgk_decontam, lattice_sampling, robust_outliers, simhash_tiles, token_binary, toxic_crf
from lexigram.llm.common import text_buffer


def texts():
    rng = np.random.default_rng(11)
    words = ["a", "bb", "the", "Éte", "river", "bad", "x" * 70, "日本", "it's", "w,", "$$"]
    made = [" ".join(rng.choice(words, 400)), "\n".join(" ".join(rng.choice(words, 9)) for _ in range(60)) * 2, "  ".join(rng.choice(words, 300)), "y" * 3000, "a b " * 700, "one", "one two", "é\tb " * 300, " lead" * 200 + " "]
    return [t for t in made if t]


@pytest.fixture
def short(monkeypatch):
    return lambda: monkeypatch.setattr(bw, "LONG", 400)


def test_pieces_cover_and_cut_between_words():
    for t in texts():
        buf, _ = text_buffer(pa.array([t]))
        cut = bw.pieces(buf, 100)
        assert [a for a, _ in cut] == [0, *[b for _, b in cut][:-1]] and cut[-1][1] == len(buf)
        raw = buf.tobytes()
        assert all(raw[b] in (0x20, 0x0A) and not raw[b - 1 : b].isspace() and not raw[b + 1 : b + 2].isspace() for _, b in cut[:-1])
    assert len(bw.pieces(text_buffer(pa.array(["ab " * 500]))[0], 100)) > 5


@pytest.mark.parametrize("k", range(len(texts())))
def test_same_results(k, short):
    buf, at = text_buffer(pa.array([texts()[k]]))
    lexicon = toxic_crf.Weights(toxic_crf.tokens(*text_buffer(pa.array(["bad river"])))[2][0], np.zeros(2))
    pieces = lattice_sampling.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    encoder = token_binary._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    key = np.array([77], np.uint64)

    def results():
        m = toxic_crf.mark(buf, at, lexicon)
        return [
            cgk_decontam.word_hashes(buf, at)[0],
            *[getattr(m, f) for f in ("place", "start", "end", "n_tokens")],
            m.pair_token[np.argsort(m.pair_token, kind="stable")],
            *lattice_sampling.encode_texts(pieces, buf, at, key),
            *encoder.encode(buf, at),
        ]

    want = results()
    fp, counts = simhash_tiles.simhash(buf, at)[0], robust_outliers.count_texts(buf, at)
    short()
    for a, b in zip(want, results(), strict=True):
        assert np.array_equal(a, b)
    assert simhash_tiles.simhash_long(buf) == int(fp)
    got = robust_outliers.count_long(buf)
    assert {c: int(got[c][0]) for c in got} == {c: int(counts[c][0]) for c in counts}


def test_a_text_over_the_limit_for_real():
    from tests.llm.test_robust_outliers import slow_counts
    from tests.llm.test_simhash_tiles import slow_fingerprint

    rng = np.random.default_rng(5)
    words = np.array(["stone", "river", "Éte", "bad", "the", "walks", "$$", "日本", "x-y", "house."])
    lines = [" ".join(line) for line in words[rng.integers(0, 10, (70_000, 12))]]
    text = "\n".join(lines + lines[:100])
    buf, at = text_buffer(pa.array([text]))
    assert len(buf) > bw.LONG and len(bw.pieces_if_long(buf)) > 3
    got = robust_outliers.count_long(buf)
    assert tuple(int(got[k][0]) for k in ("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_counts(text)
    assert simhash_tiles.simhash_long(buf) == slow_fingerprint(text)
    encoder = token_binary._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode(buf, at, None)[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    pieces = lattice_sampling.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    ids, counts = lattice_sampling.encode_texts(pieces, buf, at, np.array([3], np.uint64))
    assert lattice_sampling.decode_ids(pieces, ids, counts)[0] == buf.tobytes()
    item = cgk_decontam.Block([1], [cgk_decontam.word_hashes(*text_buffer(pa.array([lines[50_000] + " " + lines[50_001]])))[0]])
    assert [m[:3] for m in item.matches(*cgk_decontam.word_hashes(buf, at))] == [(0, 0, 0)]
