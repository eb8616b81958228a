import pickle
import random

import numpy as np

from lexigram.llm import zstd_quality as zq


def made(n=600, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(15, 200))
        good = i % 3 > 0
        text = ". ".join(" ".join(words[j : j + 8]) for j in range(0, len(words), 8))
        rows.append((i, text if good else " ".join(w + "$$$" if rng.random() < 0.5 else w + " |" for w in words), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = made()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (9001, "", "x"), (9001, "y " * 200000, "x")], "doc_id long, text string, score string")
    model = zq.train(docs, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int"))
    got = zq.score(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([(by_id[i] >= 0.3) == bool(y) for i, y in labels if i % 5 == 0]) > 0.97


def test_scores_equal_a_plain_count():
    import zstandard as z

    rows, labels = made(200)
    texts = [r[1].encode() for r in rows]
    model = pickle.loads(pickle.dumps(zq.fit(texts, np.array([y for _, y in labels]) == 1, 0.66)))
    params = z.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
    for t in [*texts[:5], b"", b"z" * 5000]:
        sizes = [sum(len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=params).compress(t[i : i + 2000])) for i in range(0, max(1, len(t)), 2000)) for d in (model.good, model.bad)]
        assert model.sizes([t])[0].tolist() == [len(t), *sizes]
    again = zq.fit(texts, np.array([y for _, y in labels]) == 1, 0.66)
    assert again.good == model.good and again.bad == model.bad and np.array_equal(again.curve, model.curve)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = zq.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert zq.score(docs, model).first()["score"] == 1.0
    assert zq.score(docs.limit(0), zq.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect() == []
