import itertools
import math
import re

import numpy as np
import pytest

from lexigram.llm import robust_outliers as ro

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return sum(map(len, words)), len(words), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [
    None, "", " \n\t", "a", "a b c d e a b c d e", "x\nx\n\nx \n x", "é é é é é é é é", "tab\tsep\x0bv\x0cf\rr\x1cw\xa0y",
    "## $$ <a> & b | %\n\n", "w" * 3000, "one two three four five six\n" * 40, "\n\n\n", "a b c d e f " * 3000,
]


def test_counts_match_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("ab \n\té#"), 300)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, x string")
    got = {r["doc_id"]: r for r in ro.robust_outliers(df).collect()}
    for i, t in enumerate(texts):
        chars, words, symbols, dup, rep = slow_counts(t)
        r = got[i]
        assert (r["word_chars"], r["n_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (chars, words, symbols, dup, rep), i
        assert r["base_failed"] == (words < 10 or 100 * rep > 20 * words)
        assert not (r["base_failed"] and r["kept"])


def test_rejects_planted_outliers_in_each_group(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gam", "delta", "epsilon", "ze", "eta", "theta", "iotas", "kap"]
    rows = []
    for i in range(900):
        text = ". ".join(" ".join(rng.choice(words, 12)) for _ in range(20))
        bad = i % 30 == 0
        if bad:
            text = " ".join(f"{w}###" for w in text.split())
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 2}", bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    got = {r["doc_id"]: r["kept"] for r in ro.robust_outliers(df).collect()}
    assert all(got[r[0]] != r[4] for r in rows)


def logdet(x, spread):
    y = x - x.mean(0)
    return np.linalg.slogdet((len(x) * (y.T @ y / len(x)) + ro.PRIOR * np.diag(spread)) / (len(x) + ro.PRIOR) + ro.FLOOR * np.eye(x.shape[1]))[1]


def test_finds_the_least_determinant_of_all_subsets():
    rng = np.random.default_rng(7)
    for n in (7, 10, 12):
        x, spread = np.r_[rng.normal(0, 1, (n - 2, ro.DIMS)), rng.normal(6, 2, (2, ro.DIMS))], rng.uniform(0.1, 2, ro.DIMS)
        h = math.ceil(ro.SHARE * n)
        least = min(logdet(x[list(c)], spread) for c in itertools.combinations(range(n), h))
        mean, scatter, got = ro.fast_mcd(x, spread, starts=200)
        assert got == pytest.approx(least, abs=1e-9)
        assert np.linalg.slogdet(ro.regularised(scatter, h, spread))[1] == pytest.approx(got)


def test_chi_square_values():
    assert ro.chi_square(0.05) == pytest.approx(12.5916, abs=1e-3) and ro.chi_square(0.001) == pytest.approx(22.4577, abs=1e-3)


def test_steps_over_all_rows_reach_the_same_estimate(spark):
    rng = np.random.default_rng(9)
    mix = rng.normal(0, 0.5, (ro.DIMS, ro.DIMS))
    x = np.r_[rng.normal(0, 1, (1300, ro.DIMS)) @ mix, rng.normal(4, 0.3, (200, ro.DIMS))]
    df = spark.createDataFrame([("g" if i % 2 else "k", v.tolist(), int(p)) for i, (v, p) in enumerate(zip(x, rng.integers(0, 2**30, len(x)), strict=True))], "grp string, x array<double>, place long")
    sizes = df.groupBy("grp").count().withColumnRenamed("count", "n")
    got, spread = ro.estimates(df, sizes, 2, sample=150)
    for r in got.collect():
        mine = x[1::2] if r["grp"] == "g" else x[::2]
        mean, scatter, best = ro.fast_mcd(mine, spread, starts=100)
        assert r["logdet"] <= best + 0.03
        d2 = lambda m, inv, mine=mine: np.einsum("ni,ij,nj->n", mine - m, inv, mine - m)
        have = d2(np.array(r["mean"]), np.array(r["inv"]).reshape(ro.DIMS, -1))
        want = d2(mean, np.linalg.inv(ro.regularised(scatter, math.ceil(0.75 * len(mine)), spread)))
        assert np.median(np.abs(np.sqrt(have) - np.sqrt(want))) < 0.1
        assert have[mine.mean(1) > 3].min() > 3 * np.median(have)
    whole = {r["grp"]: r for r in ro.estimates(df, sizes, 2)[0].collect()}
    assert whole["g"]["logdet"] == pytest.approx(ro.fast_mcd(x[1::2][np.lexsort(x[1::2].T)], spread)[2])


def test_few_rows_and_equal_rows_reject_nobody(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gam", "delta", "epsilon", "ze", "eta"]
    rows = [(i, " ".join(rng.choice(words, 40 + i % 9)), "en", f"s{i // 8}") for i in range(80)] + [(100 + i, "one two three four five six seven eight nine ten eleven", None, None) for i in range(30)]
    got = ro.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] and r["distance"] is not None for r in got if not r["base_failed"]) and sum(r["base_failed"] for r in got) < 10


def test_empty_table(spark):
    assert ro.robust_outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
