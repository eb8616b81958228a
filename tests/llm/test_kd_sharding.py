import zlib

from lexigram.llm import kd_sharding as kd

SCHEMA = "doc_id long, text string, lang string, source string, node int, shard int"


def check(rows, got, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    want = {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert all(want[r["doc_id"]] == (r["size"], r["text_crc32"]) for r in got)
    for s in range(n):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return [sum(r["size"] for r in got if r["shard"] == s) for s in range(n)]


def test_even_bytes_with_a_hot_source(spark):
    rows = [(i, "é" * (i * 37 % 90 + 1), "en" if i % 5 else "fr", "hot" if i % 3 else f"s{i % 7}", 1, 1) for i in range(4000)]
    got = kd.kd_shards(spark.createDataFrame(rows, SCHEMA), n_shards=16).collect()
    sizes = check(rows, got, 16)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 16


def test_target_bytes_and_odd_numbers(spark):
    rows = [(i, "x" * (i % 50), None, None, 1, 1) for i in range(600)] + [(None, None, None, "s", 1, 1), (-5, "", "", "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(len(r[1] or "") + 1 for r in rows)
    got = kd.kd_shards(df, target_bytes=total // 5 + 1).collect()
    sizes = check(rows, got, 5)
    assert max(sizes) < 1.1 * min(sizes)


def test_splits_lie_along_one_dimension(spark):
    rows = [(i, "x" * 10, "en" if i < 500 else "fr", "s", 1, 1) for i in range(1000)]
    got = {r["doc_id"]: r["shard"] for r in kd.kd_shards(spark.createDataFrame(rows, SCHEMA), n_shards=2).collect()}
    assert len({got[i] for i in range(500)}) == len({got[i] for i in range(500, 1000)}) == 1 and got[0] != got[999]


def test_fewer_rows_than_shards_repeats_and_empty(spark):
    rows = [(1, "a", "en", "s", 1, 1)]
    got = kd.kd_shards(spark.createDataFrame(rows, SCHEMA), n_shards=4).collect()
    assert len(got) == 1 and got[0]["slot"] == 0
    assert kd.kd_shards(spark.createDataFrame([], SCHEMA), n_shards=4).collect() == []


def test_repeated_rows_are_dealt_out(spark):
    rows = [(7, "x" * 100, "en", "s", 1, 1)] * 900 + [(None, None, "en", "s", 1, 1)] * 300 + [(i, "y" * 100, "en", "s", 1, 1) for i in range(100, 200)]
    sizes = check(rows, kd.kd_shards(spark.createDataFrame(rows, SCHEMA), n_shards=16).collect(), 16)
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 16


def plain_tree(rows, k, whole, first=0):
    """Shards of rows by a k-d tree in plain Python: widest dimension, weighted median of sizes."""
    if k == 1:
        return [(r, first) for r in rows]
    spread = [max((r[d] >> 24 for r in rows), default=0) - min((r[d] >> 24 for r in rows), default=0) for d in kd._DIMS]
    d = max(range(3), key=lambda i: spread[i] / whole[i])
    key = lambda r: (r[kd._DIMS[d]] << 16) + r["place"]
    rows, goal, run, at = sorted(rows, key=key), sum(r["size"] for r in rows) * (k // 2) / k, 0, 0
    while at < len(rows):
        same = [r for r in rows[at:] if key(r) == key(rows[at])]
        more = sum(r["size"] for r in same)
        if run + more >= goal:
            at += len(same) if run + more - goal < goal - run else 0
            break
        run, at = run + more, at + len(same)
    return plain_tree(rows[:at], k // 2, whole, first) + plain_tree(rows[at:], k - k // 2, whole, first + k // 2)


def test_equals_a_plain_tree(spark):
    rows = [(i, "é" * (i * i * 37 % 190), ("en", "fr", "de", None)[i % 4 if i % 3 else 0], "hot" if i % 3 else f"s{i % 7}", 1, 1) for i in range(1500)] + [(3, "", None, None, 1, 1)] * 40
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    at = [r.asDict() for r in kd._positions(df, "doc_id", "text", "lang", "source").collect()]
    whole = [max(1, max(r[d] >> 24 for r in at) - min(r[d] >> 24 for r in at)) for d in kd._DIMS]
    for n in (16, 5):
        want = plain_tree(at, n, whole)
        got = kd.kd_shards(df, n_shards=n).collect()
        name = lambda r, s: (r["doc_id"], r["size"], r["text_crc32"], s)
        assert sorted(name(r, r["shard"]) for r in got) == sorted(name(r, s) for r, s in want)
