"""Toxic spans by a linear-chain conditional random field, and document scores from it.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label).  A lexicon of
words and word beginnings that set toxic documents apart labels their tokens; the field has
two states, transition weights, a bias and emission weights for lexicon features, which
together maximise the conditional likelihood of the token labels (gradient from
forward-backward marginals and expected transitions, L2).  A logistic
curve on the expected number and density of toxic tokens, fitted on sampled rows that the
field didn't see, gives document scores.

Most tokens have no lexicon feature and one and the same potential.  Forward and backward
passes jump over runs of them with powers of its 2 x 2 matrix, which is exact, so a pass
costs a step for each token that has a feature; all texts of a batch advance together.

Null or empty texts have no token and get the score of a text without toxic tokens; null ids
and repeated rows stay rows of their own; an empty table gives an empty result; without rows
of both labels every score is 0.  Other columns pass through ``reject`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigram.llm import bytewords as bw
from lexigram.llm.common import labelled_sample, slices, text_buffer

#: Labelled rows of each label that the model is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1500, 16 << 20
#: Lengths of word beginnings in bytes; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
#: A lexicon feature is in so many toxic documents at least, and in this share of them, and so many times likelier there.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.025, 6.0
#: Weight of the squared emissions, and of the squared distance of transitions and bias from the labels' frequencies.
RIDGE, RIDGE_MOVES = 0.3, 1.0
#: Steps of the fit at most, and the gradient (in tokens) at which it ends.
STEPS, FLAT = 150, 0.05
THRESHOLD = 0.7
_U = np.uint64


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and end of each token, and its feature keys: word and beginnings (0: too short)."""
    start, end = bw.spans(bw.IS_PLAIN[buf], at)
    low = bw.folded(buf)
    size, first = end - start, bw.eights(low)[start]
    keys = []
    for k in BEGINNINGS:
        if k == 0:
            key = bw.mix(bw.hashes(low, start, end) + _U(1))
        else:  # up to eight bytes are a key by themselves
            key = bw.mix((first & _U(2 ** (8 * k) - 1)) + bw.mix(np.full(1, k, np.uint64)))
            key[size < k] = 0
        keys.append(key)
    return start, end, keys


class Weights:
    """Feature keys to weights; a bitmap turns most keys away."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys >> _U(48)).astype(np.int64)] = True

    def index(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are known, and which of ours they are."""
        maybe = np.flatnonzero(self.bits[(keys >> _U(48)).astype(np.int64)])
        if not len(self.keys):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        same = self.keys[place] == keys[maybe]
        return maybe[same], place[same]


@dataclass
class Marked:
    """The tokens with a feature: text, number in the text, start, end, and the features' (token, weight) pairs."""

    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    pair_token: np.ndarray
    pair_feature: np.ndarray
    n_tokens: np.ndarray


def mark(buf: np.ndarray, at: np.ndarray, lexicon: Weights) -> Marked:
    if len(at) == 2 and len(cuts := bw.pieces_if_long(buf)) > 1:  # one long text, piece by piece
        parts, pairs, done = [], 0, 0
        for low, high in cuts:
            m = mark(buf[low:high], np.array([0, high - low]), lexicon)
            m.place, m.start, m.end, m.pair_token = m.place + done, m.start + low, m.end + low, m.pair_token + pairs
            pairs += len(m.text)
            done += int(m.n_tokens[0])
            parts.append(m)
        joined = [np.concatenate([getattr(m, f) for m in parts]) for f in Marked.__dataclass_fields__]
        return Marked(*joined[:-1], np.array([done]))
    start, end, keys = tokens(buf, at)
    found = [lexicon.index(k) for k in keys]
    where = np.concatenate([f[0] for f in found])
    feature = np.concatenate([f[1] for f in found])
    marked, pair = np.unique(where, return_inverse=True)
    first = np.searchsorted(start, at)
    text = np.searchsorted(first, marked, "right") - 1
    return Marked(text, marked - first[text], start[marked], end[marked], pair, feature, np.diff(first))


@dataclass
class Field:
    """Transition weights (from, to), bias of state 1, and emission weights by feature."""

    moves: np.ndarray
    bias: float
    emissions: np.ndarray

    def __post_init__(self):
        plain = np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])
        roots, vectors = np.linalg.eig(plain)
        order = np.argsort(-roots.real)
        roots, vectors = roots.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        self.top, self.ratio = roots[0], roots[1] / roots[0]
        self.lead, self.rest = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])

    def over(self, gap: np.ndarray) -> np.ndarray:
        """Scaled matrices of runs of ``gap`` tokens without a feature."""
        return self.lead + np.power(self.ratio, gap.astype(np.float64))[:, None, None] * self.rest

    def _within(self, left: np.ndarray, gap: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Expected transitions in such runs between two vectors, summed."""
        gap = gap.astype(np.float64)
        power = np.power(self.ratio, gap)
        same = gap, gap * np.power(self.ratio, np.maximum(gap - 1, 0))
        mixed = (1 - power) / (1 - self.ratio)
        lefts = [left @ part for part in (self.lead, self.rest)]
        rights = [right @ part.T for part in (self.lead, self.rest)]
        whole = np.einsum("ni,nij,nj->n", left, self.over(gap), right)
        total = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                total += np.einsum("n,ni,nj->ij", (same[a] if a == b else mixed) / whole, lefts[a], rights[b])
        return total / self.top * np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])

    def marginals(self, m: Marked) -> np.ndarray:
        """Probability of state 1 at each marked token, by forward-backward."""
        return self.passes(m)[0]

    def passes(self, m: Marked, counts: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals; with ``counts`` also the expected transitions and the logarithm of the sum over all labellings."""
        n = len(m.text)
        expected, logz = np.zeros((2, 2)), 0.0
        if counts:
            bare = m.n_tokens[np.bincount(m.text, minlength=len(m.n_tokens)) == 0]
            start = np.tile([1.0, 0.0], (len(bare), 1))
            expected += self._within(start, bare, np.ones_like(start))
            logz += float(np.log(self.over(bare)[:, 0].sum(1)).sum()) + np.log(self.top) * float(m.n_tokens.sum() - n)
        if not n:
            return np.zeros(0), expected, logz
        score = self.bias + np.bincount(m.pair_token, self.emissions[m.pair_feature], n)
        emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], 1))  # scaled to at most 1
        new = np.r_[True, m.text[1:] != m.text[:-1]]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, n])
        gap = np.where(new, m.place, np.r_[0, m.place[1:] - m.place[:-1] - 1])
        after = m.n_tokens[m.text[first]] - 1 - m.place[first + count - 1]
        step = np.exp(self.moves)[None] * emit[:, None, :]
        by_count = np.argsort(-count, kind="stable")
        first, count, after = first[by_count], count[by_count], after[by_count]
        ahead = np.searchsorted(-count, -np.arange(int(count[0])), "left")  # texts with more than k marked tokens
        alpha, before, scale = np.zeros((n, 2)), np.zeros((n, 2)), np.ones(n)
        held = np.tile([1.0, 0.0], (len(first), 1))  # texts start outside a span
        for k, a in enumerate(ahead.tolist()):
            here = first[:a] + k
            before[here] = held[:a]
            held[:a] = np.einsum("ni,nij,njk->nk", held[:a], self.over(gap[here]), step[here])
            scale[here] = held[:a].sum(1)
            held[:a] /= scale[here][:, None]
            alpha[here] = held[:a]
        beta = np.zeros((n, 2))
        last = np.einsum("nij->ni", self.over(after))
        beta[first + count - 1] = last / last.sum(1, keepdims=True)
        for k in range(len(ahead) - 2, -1, -1):
            here = first[: ahead[k + 1]] + k
            back = np.einsum("nij,njk,nk->ni", self.over(gap[here + 1]), step[here + 1], beta[here + 1])
            beta[here] = back / back.sum(1, keepdims=True)
        both = alpha * beta
        if counts:
            ends = alpha[first + count - 1]
            logz += float(np.log(scale).sum() + np.maximum(0, score).sum() + np.log((ends * last).sum(1)).sum())
            pair = np.einsum("ni,nij->nj", before, self.over(gap))[:, :, None] * step * beta[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            expected += self._within(before, gap, np.einsum("nij,nj->ni", step, beta)) + self._within(ends, after, np.ones_like(ends))
        return both[:, 1] / both.sum(1), expected, logz


def likelihood(m: Marked, label: np.ndarray, n_features: int, start: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Penalised log-likelihood of the marked tokens' labels (others are 0), and its gradient.

    The parameters are four transitions, the bias and the emissions; ``start`` is what the first five are drawn to.
    """
    ones = float(label.sum())
    follow = (m.text[1:] == m.text[:-1]) & (m.place[1:] == m.place[:-1] + 1)
    twice = float((label[1:] & label[:-1] & follow).sum())
    final = float((label & (m.place == m.n_tokens[m.text] - 1)).sum())
    seen = np.array([[0.0, ones - twice], [ones - twice - final, twice]])
    seen[0, 0] = m.n_tokens.sum() - seen.sum()
    target = np.bincount(m.pair_feature, label[m.pair_token].astype(float), n_features)
    pull = np.r_[np.full(5, RIDGE_MOVES), np.full(n_features, RIDGE)]
    origin = np.r_[start, np.zeros(n_features)]

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        field = Field(x[:4].reshape(2, 2), float(x[4]), x[5:])
        p, expected, logz = field.passes(m, counts=True)
        value = (seen * field.moves).sum() + ones * field.bias + target @ field.emissions - logz
        had = np.bincount(m.pair_feature, p[m.pair_token], n_features)
        grad = np.r_[(seen - expected).ravel(), ones - expected[:, 1].sum(), target - had]
        off = x - origin
        return float(value - 0.5 * pull @ off**2), grad - pull * off

    return at


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, flat: float = FLAT) -> np.ndarray:
    """The place where a concave function is greatest, by limited-memory quasi-Newton steps."""
    value, grad = f(x)
    pairs: list[tuple] = []
    for _ in range(steps):
        if np.abs(grad).max() < flat:
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(grad).sum()))
        for (s, y), alpha in zip(pairs, reversed(alphas), strict=True):
            q += (alpha - (y @ q) / (s @ y)) * s
        size = 1.0
        while True:
            v, g = f(x + size * q)
            if v >= value + 1e-4 * size * (grad @ q):
                break
            size /= 2
            if size < 1e-8:
                return x
        s, y = size * q, grad - g
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        x, value, grad = x + s, v, g
    return x


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * np.r_[w[:-1], 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Weights
    field: Field
    curve: np.ndarray

    def features(self, m: Marked, p: np.ndarray) -> np.ndarray:
        n = len(m.n_tokens)
        total = np.bincount(m.text, p, n)
        return np.stack([np.log1p(total), np.log((total + 0.05) / (m.n_tokens + 10.0)), np.clip(total, 0, 1), np.clip(total - 1, 0, 1)], 1)

    def scores(self, m: Marked, p: np.ndarray) -> np.ndarray:
        x = self.features(m, p)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _runs(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``limit`` characters together, so that scratch arrays stay small."""
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > limit:
            yield low, i
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, len(texts)


def _marked(texts: list[str], lexicon: Weights) -> Marked:
    parts, base = [], 0
    for low, high in _runs(texts):
        m = mark(*text_buffer(pa.array(texts[low:high])), lexicon)
        m.text, m.pair_token = m.text + low, m.pair_token + base
        base += len(m.text)
        parts.append(m)
    return Marked(*[np.concatenate([getattr(m, f) for m in parts]) for f in Marked.__dataclass_fields__])


def fit(texts: list[str], toxic: np.ndarray, base_rate: float) -> Model:
    """A model from labelled texts; ``base_rate`` is the share of label 1 among all labelled rows."""
    toxic = np.asarray(toxic, bool)
    nothing = Model(Weights(np.zeros(0, np.uint64), np.zeros(0)), Field(np.zeros((2, 2)), -5.0, np.zeros(0)), np.array([0, 0, 0, 0, -30.0]))
    if not toxic.any() or toxic.all():
        return nothing
    part = np.arange(len(texts)) % 3  # two thirds for the field, one for the curve
    seen: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for low, high in _runs(texts):
        buf, at = text_buffer(pa.array(texts[low:high]))
        start, _, keys = tokens(buf, at)
        text = np.repeat(np.arange(low, high), bw.counts(start, at))
        for kind, into in seen.items():
            for key in keys:
                pick = (part[text] < 2) & (toxic[text] == kind) & (key != 0)
                into.append(np.unique(np.stack([key[pick], text[pick].astype(np.uint64)]), axis=1)[0])
    counts = {kind: np.unique(np.concatenate(found), return_counts=True) for kind, found in seen.items()}
    del seen
    n1, n0 = (max(1, int((part < 2)[toxic == k].sum())) for k in (True, False))
    key, inside = counts[True]
    outside = np.zeros(len(key), np.int64)
    if len(counts[False][0]):
        place = np.minimum(np.searchsorted(counts[False][0], key), len(counts[False][0]) - 1)
        outside = np.where(counts[False][0][place] == key, counts[False][1][place], 0)
    ratio = ((inside + 0.5) / (n1 + 1)) / ((outside + 0.5) / (n0 + 1))
    chosen = key[(inside >= max(LEAST_DOCS, LEAST_SHARE * n1)) & (ratio >= LEAST_RATIO)]
    if not len(chosen):
        return nothing
    lexicon = Weights(chosen, np.zeros(len(chosen)))
    fits = part < 2
    m = _marked([t for t, f in zip(texts, fits.tolist(), strict=True) if f], lexicon)
    label = toxic[fits][m.text]
    n_tokens, ones = int(m.n_tokens.sum()), int(label.sum())
    start = np.r_[np.log([1 - (ones + 1) / (n_tokens + 2), (ones + 1) / (n_tokens + 2), 0.5, 0.5]), 0.0]
    x = climb(likelihood(m, label, len(chosen), start), np.r_[start, np.zeros(len(chosen))])
    model = Model(lexicon, Field(x[:4].reshape(2, 2), float(x[4]), x[5:]), np.zeros(5))
    m = _marked(texts, lexicon)
    p = model.field.marginals(m)
    rest = part == 2
    x, y = model.features(m, p)[rest], toxic[rest]
    share = y.mean() if 0 < y.sum() < len(y) else 0.5
    model.curve = _curve(x, y.astype(float), np.where(y, base_rate / share, (1 - base_rate) / (1 - share)))
    return model


def held_out(id_col: Column, mod: int, at: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % mod == at


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``sample`` rows of each label, those with the least hashes of the id (see ``labelled_sample``)."""
    texts, y, rate = labelled_sample(docs, labels, sample, SAMPLE_BYTES, id_col, text_col, label_col)
    return fit(texts, y == 1, rate or 0.0)


_SPANS = "array<struct<start:int,end:int,p:double>>"


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, spans``: spans are the likely toxic tokens (code points, end exclusive)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches):
            buf, at = text_buffer(part.column(1))
            m = mark(buf, at, model.lexicon)
            p = model.field.marginals(m)
            score = model.scores(m, p)
            likely = p >= 0.5
            point = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=point[1:])
            origin = point[at[m.text[likely]]]
            span = pa.StructArray.from_arrays([pa.array((point[x[likely]] - origin).astype(np.int32)) for x in (m.start, m.end)] + [pa.array(p[likely])], fields=list(struct))
            ends = np.r_[0, np.cumsum(np.bincount(m.text[likely], minlength=part.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), span)], ["doc_id", "score", "spans"])

    return read.mapInArrow(run, f"doc_id {kind}, score double, spans {_SPANS}")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at_text, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, text=at_text):
            m = mark(*text_buffer(part.column(at_text)), model.lexicon)
            score = model.scores(m, model.field.marginals(m))
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(score < threshold)).columns, names)

    return docs.mapInArrow(run, docs.schema)
