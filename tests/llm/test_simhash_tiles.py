import numpy as np
import pytest
import xxhash

from lexigram.llm import simhash_tiles as st


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints):
    least = dict(enumerate(ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    least[i], changed = least[j], True
    return [least[i] for i in range(len(ids))]


TEXTS = ["", None, " \t\n", "one", "One  TWO", "one two", "a b c", "É b c d", "x " * 70000, "w" * 5000, "a b c d e f g h", "A b\nc d e f g h"]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "longer-than-others", "é"], 60)) for _ in range(12)]
    texts = TEXTS + base + [b + " ab" for b in base] + [b[:-9] + "zz zz" for b in base] + [base[0]] * 5
    df = spark.createDataFrame([(i * 3 % 1000, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, tile string")
    got = {r["doc_id"]: r for r in st.near_duplicates(df, chunk=7).collect()}
    ids, prints = [i * 3 % 1000 for i in range(len(texts))], [slow_fingerprint(t) for t in texts]
    assert {i: int(got[i]["fingerprint"], 16) for i in ids} == dict(zip(ids, prints, strict=True))
    assert [got[i]["component_id"] for i in ids] == slow_components(ids, prints)


@pytest.mark.parametrize(("group", "chunk", "radius"), [(4, 1000, 3), (50, 7, 3), (10**9, 1000, 3), (16, 9, 5), (4, 5, 0)])
def test_links_connect_what_brute_force_connects(spark, group, chunk, radius):
    rng = np.random.default_rng(group + radius)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = seeds[rng.integers(0, 40, 500)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    fp = np.unique(fp)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in st.components(st.links(df, radius, chunk, group)).collect()}
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
    nodes, roots = st._forest(a, b)
    groups = lambda pairs: sorted(sorted(n for n, r in pairs if r == root) for root in {r for _, r in pairs})
    want = groups([(int(fp.view(np.int64)[n]), int(r)) for n, r in zip(nodes, roots, strict=True)])
    assert groups([(int(x), got.get(int(x), int(x))) for x in fp.view(np.int64)]) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert st.near_duplicates(df).collect() == []


@pytest.mark.parametrize("n", [1, 40, 1500])
def test_compare_connects_all_links(n):
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.unique(seeds[rng.integers(0, 30, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)))
    u, v = st.compare(fp, None)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    a, b = np.nonzero(near)
    want = dict(zip(*(x.tolist() for x in st._forest(fp[a], fp[b])), strict=True))
    have = {int(x): int(x) for x in fp} | dict(zip(u.tolist(), v.tolist(), strict=True))
    assert have == want and len(u) <= len(fp)
    half = len(fp) // 2
    u, v = st.compare(fp[:half], fp[half:])
    across = {(int(fp[i]), int(fp[j])) for i, j in zip(a, b, strict=True) if i < half <= j}
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert all(root.get(x, x) == root.get(y, y) for x, y in across)


@pytest.mark.parametrize("most", [0, 200_000])
def test_deduplicate_keeps_one_row_a_group(spark, monkeypatch, most):
    monkeypatch.setattr(st, "_BROADCAST_KEYS", most)
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "y"), (None, "a b c d e", "z"), (None, "other words stand here", "n"), (7, "p q r s", "k"), (7, "p q r s", "k"), (7, "u v w x y", "m"), (8, None, "q"), (9, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = st.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[6], rows[7]]))


def test_population_counts_skip_most_tile_pairs():
    fp = np.random.default_rng(8).integers(0, 2**64, st.GROUP, dtype=np.uint64)
    left, right, pairs, whole = st.tile_pairs(fp, None)
    assert len(pairs) < 0.45 * whole
    cell = fp[np.bitwise_count(fp) // 4 == 8]
    assert len(st.tile_pairs(cell, None)[2]) < 0.65 * st.tile_pairs(cell, None)[3]
    # what is skipped holds no link
    some = np.unique(np.r_[fp[:2000], fp[:2000] ^ np.uint64(5), fp[:500] ^ np.uint64(1 << 63 | 1)])
    left, right, pairs, _ = st.tile_pairs(some, None)
    kept = {tuple(p) for p in pairs.tolist()}
    for i, a in enumerate(left):
        for j in range(i, len(right)):
            if (i, j) not in kept:
                assert not (np.bitwise_count(a[:, None] ^ right[j][None, :]) <= 3).any()


def test_joins_spread_hot_keys(spark, monkeypatch):
    from lexigram.llm import common, components

    monkeypatch.setattr(common, "_HOT_ROWS", 5)
    monkeypatch.setattr(common, "_HOT_KEYS", 20)
    texts = ["one and the same text here"] * 60 + [f"text number {i} of its own kind {i * i}" for i in range(60)] + ["one and the same text here now"] * 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in st.near_duplicates(df).collect()}
    assert [got[i] for i in range(130)] == slow_components(list(range(130)), [slow_fingerprint(t) for t in texts])
    star = spark.createDataFrame([(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(200, 230)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.components(star).collect()}
    assert found == {i: 0 for i in range(80)} | {i: 200 for i in range(200, 231)}
