"""Words of many texts at once, over their UTF-8 bytes.

A word is a longest run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
Every byte of a multi-byte character is 0x80 or more, so no character is cut.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD_BYTE = ~IS_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, and from the end, as little-endian integers; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    seen = np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))
    return np.ascontiguousarray(seen).view("<u8").ravel()


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    return buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def same(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``a`` and of ``b``, equal in size, hold the same bytes."""
    differ = gathered(a, a_start, size) != gathered(b, b_start, size)
    if not differ.any():
        return np.ones(len(size), bool)
    upto = np.r_[0, np.cumsum(differ)]
    ends = np.cumsum(size)
    return upto[ends] == upto[ends - size]


def spans(keep: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of kept bytes; runs end at the ends of texts."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, keep[:-1]
    first = at[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, keep[1:]
    last = at[1:]
    after[last[last > 0] - 1] = False
    return np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1


def counts(position: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each text."""
    return np.diff(np.searchsorted(position, at))


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the flags over the bytes of each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


#: Texts of more bytes are worked on piece by piece.
LONG = 1 << 22


def pieces(buf: np.ndarray, limit: int | None = None, unspaced: bool = False) -> list[tuple[int, int]]:
    """Neighbouring pieces of one text, each cut before a space or line feed between two visible bytes.

    With ``unspaced`` also before kana and the commoner Han characters, each of which is a plain word.
    """
    limit = limit or LONG // 4
    n, low, out = len(buf), 0, []
    while low < n:
        high, look = low + limit, max(limit // 4, 64)
        while high < n - 1:
            part = buf[high - 1 : high + look + 1]
            solid, here = IS_WORD_BYTE[part], part[1:-1]
            fits = ((here == 0x20) | (here == 0x0A)) & solid[:-2] & solid[2:]
            if unspaced:  # U+3040 to U+30FF and U+5000 to U+9FFF by their first bytes
                fits |= (here >= 0xE5) & (here <= 0xE9) | (here == 0xE3) & (part[2:] >= 0x81) & (part[2:] <= 0x83)
            cut = np.flatnonzero(fits)
            if len(cut):
                high += int(cut[0])
                break
            high += look
        if high >= n - 1:
            high = n
        out.append((low, high))
        low = high
    return out


def pieces_if_long(buf: np.ndarray, unspaced: bool = False) -> list[tuple[int, int]]:
    """The pieces of a text over the limit; one piece for others, and where a text has no place to cut."""
    return pieces(buf, unspaced=unspaced) if len(buf) > LONG else [(0, len(buf))]


# Constants of the public XXH64 definition (fixed values).
_P1 = 11400714785074694791
_P2 = 14029467366897019727
_P3 = 1609587929392839161
_P4 = 9650029242287828579
_P5 = 2870177450012600261


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span; the spans under 32 bytes together, the few others one by one."""
    import xxhash

    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = buf.tobytes()
        digest = xxhash.xxh64_intdigest
        out[long] = np.array([digest(raw[s : s + k], seed) for s, k in zip(start[long].tolist(), size[long].tolist(), strict=True)], np.uint64)
    short = np.flatnonzero(size < 32)
    if not len(short):
        return out
    order = short[np.argsort(size[short].astype(np.uint8), kind="stable")]
    pos, left = start[order], size[order]
    padded, eight = np.concatenate([buf, np.zeros(8, np.uint8)]), eights(buf)
    acc = left.astype(np.uint64) + U64((seed + _P5) % 2**64)
    for k in (8, 16, 24):
        i = int(np.searchsorted(left, k))
        if i < len(left):
            lane = _rotl(eight[pos[i:] + (k - 8)] * U64(_P2), 31) * U64(_P1)
            acc[i:] = _rotl(acc[i:] ^ lane, 27) * U64(_P1) + U64(_P4)
    done = left & ~7
    four = np.flatnonzero(left & 4)
    if len(four):
        lane = (eight[pos[four] + done[four]] & U64(0xFFFFFFFF)) * U64(_P1)
        acc[four] = _rotl(acc[four] ^ lane, 23) * U64(_P2) + U64(_P3)
    done = left & ~3
    for k in (1, 2, 3):
        one = np.flatnonzero((left & 3) >= k)
        if len(one):
            lane = padded[pos[one] + done[one] + (k - 1)].astype(np.uint64) * U64(_P5)
            acc[one] = _rotl(acc[one] ^ lane, 11) * U64(_P1)
    acc ^= acc >> U64(33)
    acc *= U64(_P2)
    acc ^= acc >> U64(29)
    acc *= U64(_P3)
    acc ^= acc >> U64(32)
    out[order] = acc
    return out


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; where a chance clash would matter, compare with :func:`same`."""
    return xxh64(buf, start, end - start)


def one_hash(word: bytes) -> int:
    """The hash that :func:`hashes` gives this span."""
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


#: Bytes of plain words: ASCII letters and digits and all of other characters.
IS_PLAIN = np.zeros(256, bool)
IS_PLAIN[48:58] = IS_PLAIN[65:91] = IS_PLAIN[97:123] = IS_PLAIN[128:] = True


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals (C3 80 to C3 9E but the times sign), byte for byte."""
    low = LOWER[buf]
    after = np.flatnonzero(buf == 0xC3) + 1
    after = after[after < len(buf)]
    after = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    low[after] += 32
    return low


#: First and last characters of scripts that put no spaces between words: Thai to Tibetan, Myanmar, Khmer, Tai, Balinese,
#: Javanese, Han and its radicals, kana, Bopomofo, Yi (fixed values of Unicode); and of their punctuation.
_UNSPACED = (
    (0x0E01, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F),
    (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_PUNCTUATION = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _among(code: np.ndarray, ranges: tuple) -> np.ndarray:
    ranges = np.array(ranges)
    at = np.searchsorted(ranges[:, 0], code, "right") - 1
    return (at >= 0) & (code <= ranges[at, 1])


def plain_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each plain word; a character of an unspaced script is a word of its own."""
    keep = IS_PLAIN[buf]
    start, end = spans(keep, at)
    lead = np.flatnonzero((buf == 0xE0) | (buf == 0xE1) | (buf >= 0xE2) & (buf <= 0xF3))
    if not len(lead):
        return start, end
    tail = np.r_[buf, np.zeros(3, np.uint8)]
    b0, b1, b2, b3 = (tail[lead + i].astype(np.int64) & 63 for i in range(4))
    long = buf[lead] >= 0xF0
    code = np.where(long, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, (b0 & 15) << 12 | b1 << 6 | b2)
    mark = _among(code, _PUNCTUATION)
    alone = _among(code, _UNSPACED) & ~mark
    if not (mark | alone).any():
        return start, end
    size = 3 + long.astype(np.int64)
    gone = lead[mark]
    for i in range(3):
        keep[gone + i] = False
    start, end = spans(keep, at)
    # words also part before and after a character that stands alone
    first, last = lead[alone], (lead + size)[alone]
    starts = np.concatenate([start, first, last[np.r_[keep, False][last]]])
    ends = np.concatenate([end, last, first[np.r_[False, keep][first]]])
    return np.unique(starts), np.unique(ends)
