import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lexigram.llm import toxic_crf as tc
from lexigram.llm.common import text_buffer


def field(n, seed=0):
    rng = np.random.default_rng(seed)
    return tc.Field(np.log(np.array([[0.9, 0.1], [0.4, 0.6]])), -1.5, rng.normal(2, 1, n))


def brute(f, scores):
    """Marginals of state 1 by summing over all sequences of states."""
    total, ones = 0.0, np.zeros(len(scores))
    for ys in itertools.product((0, 1), repeat=len(scores)):
        w, before = 0.0, 0
        for y, s in zip(ys, scores, strict=True):
            w += f.moves[before, y] + y * s
            before = y
        total += np.exp(w)
        ones += np.exp(w) * np.array(ys)
    return ones / total


def test_marginals_match_enumeration():
    rng = random.Random(1)
    known = [tc.tokens(*text_buffer(pa.array([w])))[2][0][0] for w in ("bad", "worse", "worst")]
    lexicon = tc.Weights(np.array(known, np.uint64), np.zeros(3))
    f = field(3)
    texts = ["", "bad", "ok", "bad bad", " ".join(["ok"] * 5 + ["worse"] + ["ok"] * 6)] + [" ".join(rng.choices(["ok", "bad", "worse", "worst", "x"], k=rng.randint(1, 11))) for _ in range(40)]
    m = tc.mark(*text_buffer(pa.array(texts)), lexicon)
    p = f.marginals(m)
    order = np.argsort(np.array(known, np.uint64))
    weight = dict(zip([("bad", "worse", "worst")[i] for i in order], f.emissions, strict=True))
    got = {(t, k): v for t, k, v in zip(m.text.tolist(), m.place.tolist(), p.tolist(), strict=True)}
    for t, text in enumerate(texts):
        words = text.split()
        want = brute(f, [f.bias + weight.get(w, 0.0) for w in words])
        for k, w in enumerate(words):
            assert (w in weight) == ((t, k) in got)
            if w in weight:
                assert got[t, k] == pytest.approx(want[k], rel=1e-9)


def test_gradient_matches_enumeration_and_ends_flat():
    rng = random.Random(4)
    known = [tc.tokens(*text_buffer(pa.array([w])))[2][0][0] for w in ("bad", "worse", "worst")]
    lexicon = tc.Weights(np.array(known, np.uint64), np.zeros(3))
    texts = ["", "ok ok", "bad", "bad bad", "ok worse", "worst ok ok ok"] + [" ".join(rng.choices(["ok", "ok", "bad", "worse", "worst"], k=rng.randint(1, 9))) for _ in range(30)]
    m = tc.mark(*text_buffer(pa.array(texts)), lexicon)
    label = np.array([rng.random() < 0.7 for _ in m.text])
    start = np.log([0.8, 0.2, 0.5, 0.5, 0.6])
    f = tc.likelihood(m, label, 3, start)
    x = np.array([-0.1, -2.0, -1.2, -0.4, -0.7, 1.0, 2.0, -0.5])
    value, grad = f(x)
    score = {(t, k): s for t, k, s in zip(m.text.tolist(), m.place.tolist(), np.bincount(m.pair_token, x[5:][m.pair_feature]), strict=True)}
    mine = {(t, k): y for t, k, y in zip(m.text.tolist(), m.place.tolist(), label.tolist(), strict=True)}
    total = 0.0
    for t, text in enumerate(texts):
        n = len(text.split())

        def weight(ys, t=t):
            moves, before, w = x[:4].reshape(2, 2), 0, 0.0
            for k, y in enumerate(ys):
                w += moves[before, y] + y * (x[4] + score.get((t, k), 0.0))
                before = y
            return w

        total += weight([int(mine.get((t, k), False)) for k in range(n)]) - np.log(sum(np.exp(weight(ys)) for ys in itertools.product((0, 1), repeat=n)))
    off = x - np.r_[start, np.zeros(3)]
    assert value == pytest.approx(total - 0.5 * (tc.RIDGE_MOVES * (off[:5] ** 2).sum() + tc.RIDGE * (off[5:] ** 2).sum()), rel=1e-9)
    for i in range(len(x)):
        near = [f(x + d * np.eye(len(x))[i])[0] for d in (1e-5, -1e-5)]
        assert grad[i] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-4)
    best = tc.climb(f, np.r_[start, np.zeros(3)], flat=1e-6)
    assert np.abs(f(best)[1]).max() < 1e-5 and f(best)[0] > value


def test_fit_of_a_corpus_ends_flat(monkeypatch):
    rows, labels = corpus()
    ended = []
    monkeypatch.setattr(tc, "climb", lambda f, x, climb=tc.climb: ended.append((f, climb(f, x))) or ended[-1][1])
    tc.fit([r[1] for r in rows], np.array([y for _, y in labels]) == 1, 0.25)
    ((f, x),) = ended
    assert np.abs(f(x)[1]).max() < tc.FLAT and len(x) > 5


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    clean = ["tree", "river", "été", "cloud", "stone", "walk", "green"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else int(i % 7 == 1)):
            words[rng.randrange(len(words))] = rng.choice(["Jerkface", "blorgon", "blorgish"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_tags_and_rejects(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (9001, "", "x"), (9002, "é jerkface, é BLORGISH jerkface", "x"), (9002, "walk", "x")], "doc_id long, text string, score string")
    model = tc.train(docs.where("doc_id % 3 <> 1 or doc_id is null"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = tc.tag(docs, model).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 9000}
    right = [(by_id[i]["score"] >= 0.7) == bool(y) for i, y in labels if i % 3 == 1]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    (odd,) = [r for r in got if r["doc_id"] == 9002 and r["spans"]]
    text = "é jerkface, é BLORGISH jerkface"
    assert [text[s["start"] : s["end"]] for s in odd["spans"]] == ["jerkface", "BLORGISH", "jerkface"]
    kept = tc.reject(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in got if r["score"] < 0.7)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "bad words")], "doc_id long, text string")
    model = tc.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert tc.tag(docs, model).first()["score"] < 1e-6
    assert tc.tag(docs.limit(0), model).collect() == [] and tc.reject(docs.limit(0), model).collect() == []


def test_training_rows_are_taken_once_and_bounded(spark):
    from lexigram.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c" * 50), (3, "d" * 60), (4, "e"), (None, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (4, 1), (5, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    texts, y, rate = labelled_sample(docs, labels, 10, 100, "doc_id", "text", "toxic")
    assert rate == pytest.approx(4 / 7) and sorted(zip(texts, y.tolist(), strict=True))[0] == ("", 1) and len(texts) == 2 and sum(y) == 1
    assert len(labelled_sample(docs, labels, 1, 1 << 20, "doc_id", "text", "toxic")[0]) <= 2
    assert len(labelled_sample(docs, labels, 9, 1 << 20, "doc_id", "text", "toxic")[0]) == 3
