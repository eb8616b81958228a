import random

import pytest
from pyspark.sql import functions as F

from lexigram.operators import runs
from lexigram.operators.aggregate import count_windows
from lexigram.operators.windows import array_windows, names
from lexigram.plans import catalogue


def rows_of(df, n):
    return {tuple(r[t] for t in names(n)): r["count"] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 4, 7, 10])
def test_runs_count_what_windows_count(spark, n, monkeypatch):
    monkeypatch.setattr(runs, "RUN", 8)
    rng = random.Random(n)
    words = ["the", "of", "a", "gathering", "weather", "tremendous", "čřž", "語", "x" * 40]
    seqs = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(30)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, seqs[0], ["the"] * 90, ["gathering"] * 90, [], None])], "doc_id long, t array<string>")
    want = rows_of(count_windows(array_windows(docs, n, F.col("t")), n), n)
    assert rows_of(runs.count_runs(docs, n, F.col("t")), n) == want
    assert rows_of(runs.count_runs(docs, n, F.col("t"), 3, parts=2), n) == {k: v for k, v in want.items() if v >= 3}


@pytest.mark.parametrize("n", [4, 10])
def test_long_windows_are_shuffled_in_runs(spark, n):
    plan = catalogue.QUERIES[f"ngrams_{n}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(t1" not in plan and plan.count("hashpartitioning(") == 1


def test_levels_repeat_no_row(spark):
    assert "Expand" not in catalogue.QUERIES["index_levels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
