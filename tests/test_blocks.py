import os
import random

import pytest
from pyspark.sql import functions as F

from lexigram import build
from lexigram.config import BuildConf
from lexigram.functions.text import tokens
from lexigram.operators import aggregate, blocks
from lexigram.operators.aggregate import count_windows
from lexigram.operators.blocks import count_blocks
from lexigram.operators.windows import array_windows, names
from lexigram.plans import catalogue, stored

WORDS = ["the", "of", "a", "weather", "čřž", "語", "", "x" * 40]


def rows_of(df, n, *more):
    return {tuple(r[t] for t in names(n)): (r["count"], *[r[m] for m in more]) for r in df.collect()}


@pytest.fixture(params=[7, 1 << 20])
def block(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_blocks_count_what_windows_count(spark, block, n):
    rng = random.Random(n)
    seqs = [[rng.choice(WORDS) for _ in range(rng.randint(0, 60))] for _ in range(30)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, seqs[0], ["the"] * 90, [], None, ["a", None, "of"] * 9])], "doc_id long, tok array<string>")
    for stop, least in (([], 0), (["a"], 3)):
        want = rows_of(count_windows(array_windows(docs, n, F.col("tok"), stop=stop), n, least), n)
        assert rows_of(count_blocks(docs, n, least, stop=stop, parts=3), n) == want
    begun = {k: v for k, v in rows_of(count_windows(array_windows(docs, n, F.col("tok")), n), n).items() if k[0].startswith(("t", "語"))}
    assert rows_of(count_blocks(docs, n, prefixes=["t", "語"]), n) == begun


def test_plain_texts_are_cut_as_tokens_are(spark, block):
    texts = ["Lorem ipsum, DOLOR.\tsit;amet?! a:b  ", "", "...", None, "end", "of", " of", "Žluťoučký\nkůň\r\fŽluťoučký kůň", ".x", "x.", "a\x0bb\xa0c d", "İ ΣΑΣ straße"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for n in (1, 2):
        want = rows_of(count_windows(array_windows(docs, n, tokens(F.col("text"))), n), n)
        assert rows_of(count_blocks(docs.select(F.lower("text").alias("tok")), n), n) == want


def test_first_attributes_in_blocks(spark, block):
    rng = random.Random(5)
    docs = [(i, [rng.choice(WORDS) for _ in range(20)], rng.choice(["x", "y", None]), f"s{i}") for i in rng.sample(range(-50, 50), 60)]
    docs = spark.createDataFrame([*docs, (None, ["only", "here"], "x", "z"), (None, ["the", "of"], "x", "z")], "doc_id long, tok array<string>, lang string, source string")
    keep = [F.col(c) for c in ("doc_id", "lang", "source")]
    want = rows_of(count_windows(array_windows(docs, 2, F.col("tok"), keep=keep), 2, 0, ["lang", "source"], ["doc_id"]), 2, "lang", "source")
    assert rows_of(count_blocks(docs, 2, 0, ["lang", "source"], "doc_id", parts=3), 2, "lang", "source") == want
    assert want["only", "here"] == (1, None, None)
    with pytest.raises(ValueError):
        count_blocks(docs, 2, attrs=["lang"])


@pytest.mark.parametrize("parts", [1, 5, 200])
def test_each_label_has_a_partition_of_its_own(spark, parts):
    labels = blocks._labels(parts).tolist()
    rows = spark.createDataFrame([(x,) for x in labels], "x int").repartition(parts, "x").select("x", F.spark_partition_id().alias("p")).collect()
    assert {r["x"]: r["p"] for r in rows} == {x: i for i, x in enumerate(labels)}


@pytest.mark.parametrize("name", ["min_frequency", "encoded_bigrams", "ngrams_2", "vertical_filter_args"])
def test_no_window_is_shuffled_as_a_row(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "__blob" in plan and "hashpartitioning(t1#0, t2" not in plan and "partial_count(1)" not in plan


def test_tasks_follow_the_size_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART_BYTES", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert count_blocks(docs.select(F.lower("text").alias("tok")), 2).rdd.getNumPartitions() == -(-os.path.getsize("/root/testdata/sf0.001/documents.parquet") // (1 << 14))


def test_vertical_files_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stored, "FILE_BYTES", 1 << 14)
    assert len(spark.read.text(stored._vertical(spark, "/root/testdata/sf0.001")).inputFiles()) > spark.sparkContext.defaultParallelism


def test_built_stop_strings_and_prefixes(spark, tmp_path):
    (tmp_path / "v").write_text("<doc>\nthe\ntree\nof\ntrees\n</doc>\n<doc>\ntree\nof\n</doc>\n")
    conf = lambda **more: BuildConf(f"{tmp_path}/v", "vertical", **more)
    assert rows_of(build.ngrams(spark, conf(stop=["the"]), 2), 2) == {("tree", "of"): (2,), ("of", "trees"): (1,)}
    assert rows_of(build.ngrams(spark, conf(match_prefix=["tr"]), 2), 2) == {("tree", "of"): (2,)}


def test_ranges_are_found_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "_PER_RANGE", 2)
    words = sorted(f"{i * i % 9001:05d}" for i in range(1000))
    words = sorted(set(words))
    out = aggregate.dense_ids(spark.createDataFrame([(w,) for w in words], "w string"), [F.col("w")])
    assert {r["w"]: r["id"] for r in out.collect()} == {w: i for i, w in enumerate(words)}
    # a row meets every 14th of the bounds, and 14 between two of them
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ranges_of_windows_come_in_order(spark, block, n):
    rng = random.Random(n)
    docs = spark.createDataFrame([(i, " ".join(rng.choice([*WORDS, "ža", "z", "\U0001f600", "￿"]) for _ in range(40))) for i in range(60)], "doc_id long, text string")
    want = rows_of(count_windows(array_windows(docs, n, tokens(F.col("text"))), n), n)
    out = count_blocks(docs.select(F.lower("text").alias("tok")), n, parts=5, ranges=True)
    rows = [tuple(r[t].encode() for t in names(n)) for r in out.collect()]
    assert rows_of(out, n) == want and rows == sorted(rows)
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert len(sizes) <= 5 and sum(s > 0 for s in sizes) > (n > 1)
    assert count_blocks(docs.where("false").select(F.lower("text").alias("tok")), n, ranges=True).count() == 0


def test_a_stored_index_is_not_dealt_again(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stored, "write_index", lambda rows, path, dealt=False: seen.append((dealt, rows._jdf.queryExecution().executedPlan().toString())))
    stored._stored(spark, "/root/testdata/sf0.001", 2, attrs=True)
    assert seen[0][0] and "rangepartitioning" not in seen[0][1] and "Sort" not in seen[0][1]
