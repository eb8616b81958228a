"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexigram.functions.text import tokens
from lexigram.operators.aggregate import count_windows
from lexigram.operators.store import open_index, write_export, write_index
from lexigram.operators.windows import array_windows
from lexigram.plans.search import SearchArgs, matching, search
from lexigram.sources.readers import spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
LOOKUPS = 20


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lexigram-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def touched(path: str, word: str) -> dict[str, int]:
    """Files and row groups of an index whose bounds let a lookup of ``word`` read them, of how many, and bytes in all."""
    import glob

    import pyarrow.parquet as pq

    out = {"files": 0, "files_read": 0, "groups": 0, "groups_read": 0, "bytes": 0}
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        bounds = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        hits = sum(b.min <= word <= b.max for b in bounds)
        for k, v in (("files", 1), ("files_read", hits > 0), ("groups", len(bounds)), ("groups_read", hits), ("bytes", os.path.getsize(f))):
            out[k] += int(v)
    return out


def main() -> None:
    spark = session()
    docs = spread(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    folder = tempfile.mkdtemp(prefix="lexigram-bench-")
    times: dict[str, float] = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - began, 4)

    def ngrams(n: int, keep=(), attrs=(), min_freq: int = 2):
        w = array_windows(docs, n, tokens(F.col("text")), keep=[F.col(c) for c in keep])
        return count_windows(w, n, min_freq, list(attrs), ["doc_id"] if attrs else None)

    def total(df) -> None:
        df.agg(F.count("*"), F.sum("count")).collect()

    try:
        timed("bigram_cold", lambda: total(ngrams(2)))
        for n, name in ((1, "unigram"), (2, "bigram"), (3, "trigram"), (6, "sixgram")):
            timed(name, lambda n=n: total(ngrams(n)))
        timed("bigram_attrs", lambda: total(ngrams(2, ("doc_id", "lang", "source"), ("lang", "source"))))
        timed("index_write", lambda: write_index(ngrams(3), f"{folder}/index"))
        timed("index_write_all", lambda: write_index(ngrams(3, min_freq=1), f"{folder}/all"))
        read = touched(f"{folder}/index", "on")
        index = open_index(spark, f"{folder}/index")
        kinds = {
            "exact": lambda: matching(index, SearchArgs("on")).count(),
            "prefix": lambda: matching(index, SearchArgs("th*")).count(),
            "regexp": lambda: matching(index, SearchArgs("th[ea].*", "regexp")).count(),
            "regexp_plain": lambda: matching(index, SearchArgs("th[ea].*", "regexp"), use_candidates=False).count(),
            "page": lambda: search(index, SearchArgs("th*", offset=100, limit=50)).collect(),
        }
        for f in kinds.values():
            f()
        for name, f in kinds.items():
            runs = []
            for _ in range(LOOKUPS):
                began = time.perf_counter()
                f()
                runs.append(time.perf_counter() - began)
            times[f"{name}_p50"] = round(statistics.median(runs), 4)
            times[f"{name}_p95"] = round(sorted(runs)[int(0.95 * LOOKUPS)], 4)
        timed("export", lambda: write_export(index, f"{folder}/export", 4))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    value = round(sum(v for k, v in times.items() if not k.endswith(("_p50", "_p95"))), 3)
    print(json.dumps({"metric": "ngram_build_and_search", "value": value, "unit": "sec", "queries": times, "index": read, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
