"""Strings that a polynomial hash modulo 2**64 can't tell apart, and hashes that clash on purpose."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from lexigram.llm import bytewords as bw
from lexigram.llm import cgk_decontam, lattice_sampling, robust_outliers, token_binary, toxic_crf
from lexigram.llm.common import text_buffer


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def test_spans_and_lead_bytes():
    rng = np.random.default_rng(4)
    buf = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 2990, 400)
    size = np.minimum(rng.integers(0, 70, 400), 3000 - start)
    raw = buf.tobytes()
    want = [xxhash.xxh64_intdigest(raw[s : s + k], 42) for s, k in zip(start, size, strict=True)]
    assert bw.hashes(buf, start, start + size).tolist() == want and bw.one_hash(raw[:9]) == xxhash.xxh64_intdigest(raw[:9], 42)
    other = buf.copy()
    other[1500] ^= 1
    differ = [s <= 1500 < s + k for s, k in zip(start, size, strict=True)]
    assert (~bw.same(buf, start, other, start, size)).tolist() == differ
    assert bw.eights(buf[:3]).tolist() == [int.from_bytes(raw[i:3], "little") for i in range(4)]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_words_lines_and_units_stay_apart(pair):
    x, y = pair
    buf, at = text_buffer(pa.array([f"{x}\n{y}\n{x}", f"{x} {y} {y}"]))
    got = robust_outliers.count_texts(buf, at)
    assert got["n_dup_lines"].tolist() == [1, 0] and got["n_stutters"].tolist() == [0, 1]
    words, _ = cgk_decontam.word_hashes(buf, at)
    assert len(set(words.tolist())) == 2
    assert len(set(toxic_crf.tokens(buf, at)[2][0].tolist())) == 2
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{x} {y}", f"{y} {x}", y]
    ids, counts = token_binary._encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(*text_buffer(pa.array(texts)))
    assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids + [2]]
    pieces = lattice_sampling.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    buf, at = text_buffer(pa.array(texts))
    ids, counts = lattice_sampling.encode_texts(pieces, buf, at, np.arange(3, dtype=np.uint64))
    assert [t.decode() for t in lattice_sampling.decode_ids(pieces, ids, counts)] == texts


def test_clashing_hashes_are_mended(monkeypatch):
    texts = ["one two three", "six two ten", "one", "ten ten one two", "other words"]
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(vocab)
    monkeypatch.setattr(token_binary.Encoder, "_keys", staticmethod(lambda buf, start, end: np.full(len(start), 7, np.uint64)))
    e = token_binary.Encoder(vocab)
    for part in (texts, texts[::-1]):
        assert e.encode(*text_buffer(pa.array(part)))[0].tolist() == [i for t in part for i in whole.encode(t, add_special_tokens=False).ids + [2]]
    pieces = lattice_sampling.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    buf, at = text_buffer(pa.array(texts))
    want = lattice_sampling.encode_texts(pieces, buf, at, np.arange(5, dtype=np.uint64))
    monkeypatch.setattr(bw, "hashes", lambda buf, start, end: np.full(len(start), 7, np.uint64))
    got = lattice_sampling.encode_texts(pieces, buf, at, np.arange(5, dtype=np.uint64))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_pieces_of_lines_and_of_unspaced_text():
    lines = text_buffer(pa.array(["abcdefgh\n" * 400]))[0]
    cut = bw.pieces(lines, 100)
    assert len(cut) > 20 and all(lines[b] == 0x0A for _, b in cut[:-1])
    han = "今日はとても良い天気ですね。" * 300
    buf, at = text_buffer(pa.array([han]))
    assert len(bw.pieces(buf, 300)) == 1 and len(cut := bw.pieces(buf, 300, unspaced=True)) > 20
    want = cgk_decontam.word_hashes(buf, at)[0]
    assert np.array_equal(want, np.concatenate([cgk_decontam.word_hashes(buf[a:b], np.array([0, b - a]))[0] for a, b in cut]))
