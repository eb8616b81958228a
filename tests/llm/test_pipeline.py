import os

import pytest

import corpus_pipeline
from lexigram.llm import credential_links, queries


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A small corpus with one case of each kind, as the tables that the stages read."""
    where = str(tmp_path_factory.mktemp("tables"))
    bad = ["grumbo", "snarfle", "blitzen"]
    clean = "stone river walk green cloud tree light moves over north field and house window garden path".split()
    text = lambda i, n=40: " ".join(clean[(i * 7 + j * j * (i % 5 + 1) + j) % len(clean)] + str((i * j) % 17) for j in range(n))
    item = "an item of the benchmark asks how many stones lie in the river by the old house"
    docs, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0 and i < 250
        docs.append((i, text(i) + (" " + " ".join(bad) if toxic else ""), "en", "s", 1))
        if i < 250:
            labels.append((i, 1, int(toxic)))
    docs += [(1001, text(1001), "en", "s", 1), (1002, text(1001), "fr", "s", 1), (1003, text(33) + " " + item.upper() + ". " + text(34), "en", "s", 1)]
    docs += [(1004, text(77, 30) + ' token = "abcdef0123456789abcdef" ' + text(78, 30), "en", "s", 1), (1005, "", "en", "s", 0), (None, None, None, None, None), (1006, text(200) + " grumbo snarfle blitzen snarfle", "en", "s", 1)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item), (2, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return where, docs


def test_each_stage_takes_effect(spark, made, tmp_path):
    where, docs = made
    at, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    columns = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, where).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
    assert 1006 not in seen["toxicity"] and 10 not in seen["toxicity"] and {1, 2, 3, 1001, 1002, 1003, 1004, 1005} <= set(seen["toxicity"])
    near = seen["near_duplicates"]
    assert 1001 in near and 1002 not in near and 1005 in near and None not in near
    assert 1003 in near and set(near) - set(seen["decontamination"]) == {1003}
    assert "[secret]" in seen["secrets"][1004]["text"] and seen["secrets"][1004]["n_chars"] == len(seen["secrets"][1004]["text"])
    assert not any(credential_links.strong_spans(r["text"] or "") for r in seen["secrets"].values())
    assert set(seen["segmentation"]) == set(seen["secrets"]) and all(r["lossless"] for r in seen["segmentation"].values())


def test_run_and_queries(spark, made):
    where, _ = made
    out = corpus_pipeline.run(spark, where)
    assert out.count() > 100
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == ["segmentation"]
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_documents(spark, made, tmp_path):
    where, _ = made
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{where}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
