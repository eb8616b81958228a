from collections import Counter

import pytest

from lexigram import build
from lexigram.config import BuildConf
from lexigram.operators.aggregate import count_windows
from lexigram.operators.windows import names, packed_windows
from lexigram.plans import catalogue, stored
from lexigram.sources import packed


@pytest.fixture
def pieces(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n", [1, 2, 5])
@pytest.mark.parametrize("held", [3, 1000])
def test_windows_run_across_pieces_and_files(spark, tmp_path, monkeypatch, pieces, n, held):
    monkeypatch.setattr(packed, "TOKENS", held)
    words = [f"w{i * i % 17}" for i in range(250)]
    parts = [words[:100], words[100:102], [], words[102:103], words[103:]]
    for i, p in enumerate(parts):
        (tmp_path / f"part-{i}").write_text("".join(f"{w}{', ' if j % 3 else chr(10)}" for j, w in enumerate(p)))
    grams = lambda ws: Counter(zip(*[ws[i:] for i in range(n)], strict=False))
    for joined, want in ((True, grams(words)), (False, sum((grams(p) for p in parts), Counter()))):
        rows = count_windows(packed_windows(packed.plain(spark, str(tmp_path), n, joined=joined).rows, n), n).collect()
        assert {tuple(r[t] for t in names(n)): r["count"] for r in rows} == want


@pytest.mark.parametrize("combinations", [0, 65_536])
def test_attributes_and_structures_run_across_pieces(spark, tmp_path, monkeypatch, pieces, combinations):
    monkeypatch.setattr(packed, "COMBINATIONS", combinations)
    lines, want, first = [], Counter(), {}
    for d in range(40):
        kept = [f"w{(d * 7 + i) % 23}" for i in range(25)]
        lines += [f'<doc file="f{d % 9}">', "<skip>", *["no"] * 30, "</skip>", *kept, "</doc>", "between"]
        if d % 9 != 4:
            for pair in zip(kept, kept[1:], strict=False):
                want[pair] += 1
                first.setdefault(pair, f"f{d % 9}")
    (tmp_path / "v").write_text("\n".join(lines) + "\n")
    rules = [[{"attr": "doc.file", "op": "!=", "value": "f4"}]]
    conf = BuildConf(f"{tmp_path}/v", "vertical", attrs={"doc.file": "col8"}, filter_args=rules, ignore_structs=["skip"])
    got = build.ngrams(spark, conf, 2).collect()
    assert {(r["t1"], r["t2"]): (r["count"], r["doc_file"]) for r in got} == {k: (v, first[k]) for k, v in want.items()}


@pytest.mark.parametrize("name", ["vertical_attrs", "plain_gzip"])
def test_files_are_not_shuffled_before_their_windows_are_counted(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "SortAggregate" not in plan and "Window" not in plan


def test_plain_texts_are_many_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stored, "FILE_BYTES", 1 << 16)
    path = stored._plain(spark, "/root/testdata/sf0.001", compression="gzip")
    assert len(spark.read.text(path).inputFiles()) > 1
