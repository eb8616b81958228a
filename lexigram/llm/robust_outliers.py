"""Quality rules: base statistics of texts, and robust multivariate outliers.

``statistics`` counts words, symbols, repeated lines, repeated five-word windows, capitals
and words that follow themselves in every whole text.  ``robust_outliers`` turns the counts
into transformed rates, estimates centre and scatter for every language and source by the
minimum covariance determinant, and rejects rows by Mahalanobis distance at a chi-square
level.

The estimate of a group is the ``SHARE`` of its rows whose scatter has the least determinant.
The scatter is regularised, always in the same way: ``PRIOR`` rows' worth of the corpus' own
spread are mixed in, and ``FLOOR`` is added to every variance.

- ``fast_mcd`` works on all rows of a group, or on about ``SAMPLE`` of them where it has more:
  many random starts and one by medians, two concentration steps each (keep the rows nearest
  to the estimate, estimate again), the best few until their determinant falls no more.
- For groups with more rows that is the start of the same steps over all their rows.  Each is
  an aggregation of counts, sums and cross products that is combined before the shuffle, so no
  group is gathered anywhere; they end where no group's determinant falls.

Null or empty texts have no words and fail the base rule.  Null languages and sources are
groups of their own, null ids stay, repeated rows count each; an empty table gives an
empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigram.llm import bytewords as bw
from lexigram.llm.common import cut, slices, text_buffer

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutters")
#: Share of a group's rows that its estimate rests on.
SHARE = 0.75
#: Added to every variance: differences of a transformed statistic much under its root never reject.
FLOOR = 0.02
#: Rows' worth of the corpus' spread in a group's scatter.
PRIOR = 20
#: Chance, by the chi-square law, of a row further away than those kept.
LEVEL = 1e-5
#: Rows of a group that are worked on together, random starts, those that are carried on, and most steps.
SAMPLE, STARTS, CARRIED, STEPS = 2000, 30, 3, 40
#: A determinant falls if its logarithm does by this much.
FALL = 1e-3
#: Width of a histogram's bins (of statistics, and of the logarithm of squared distances), and what the logarithm starts at.
STEP, LEAST_D2 = 0.02, 0.01
_BROADCAST_GROUPS = 20_000


def count_texts(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n_texts = len(at) - 1
    out = {k: np.zeros(n_texts, np.int64) for k in COUNTS}
    if not len(buf):
        return out
    solid = bw.IS_WORD_BYTE[buf]
    start, end = bw.spans(solid, at)
    words = bw.counts(start, at)
    out["n_words"] = words
    out["word_chars"] = bw.per_text(solid & ((buf & 0xC0) != 0x80), at)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER)):
        out[name] = bw.per_text(kind[buf], at)

    first, last = bw.spans(buf != 0x0A, at)
    worded = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last = first[worded], last[worded]
    out["n_lines"] = bw.counts(first, at)
    owner = np.repeat(np.arange(n_texts, dtype=np.uint64), out["n_lines"])
    key = bw.mix(bw.hashes(buf, first, last) + bw.mix(owner))
    _, lead = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[lead] = False
    out["n_dup_lines"] = np.bincount(owner[again].astype(np.int64), minlength=n_texts)

    owner = np.repeat(np.arange(n_texts, dtype=np.uint64), words)
    _count_repeats(out, bw.hashes(buf, start, end), owner)
    return out


def _count_repeats(out: dict[str, np.ndarray], word: np.ndarray, owner: np.ndarray) -> None:
    """Words that follow themselves and words in repeated windows, from hashes of all words."""
    n_texts = len(out["n_words"])
    stutter = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutters"] = np.bincount(owner[1:][stutter].astype(np.int64), minlength=n_texts)
    if len(word) >= WINDOW:
        m = len(word) - WINDOW + 1
        window = bw.mix(owner[:m])
        for i in range(WINDOW):
            window = bw.mix(window * np.uint64(0x9E3779B97F4A7C15) + word[i : i + m])
        whole = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        order = np.argsort(window[whole])
        ranked = window[whole][order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(ranked), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = whole[order[twice]]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out["n_repeat_words"] = np.bincount(owner[covered].astype(np.int64), minlength=n_texts)


def count_long(buf: np.ndarray) -> dict[str, np.ndarray]:
    """The same counts of one long text: sums over its pieces, hashes of all words, digests of all lines."""
    import hashlib

    parts, words = [], []
    for low, high in bw.pieces(buf):
        piece, ends = buf[low:high], np.array([0, high - low])
        start, end = bw.spans(bw.IS_WORD_BYTE[piece], ends)
        words.append(bw.hashes(piece, start, end))
        solid = bw.IS_WORD_BYTE[piece]
        parts.append((len(start), int((solid & ((piece & 0xC0) != 0x80)).sum()), int(_SYMBOL[piece].sum()), int(_UPPER[piece].sum())))
    out = {k: np.zeros(1, np.int64) for k in COUNTS}
    for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_upper")):
        out[name][0] = sum(p[k] for p in parts)
    seen: set[bytes] = set()
    breaks = np.r_[-1, np.flatnonzero(buf == 0x0A), len(buf)].tolist()
    for a, b in zip(breaks[:-1], breaks[1:], strict=True):
        line = buf[a + 1 : b]
        if bw.IS_WORD_BYTE[line].any():
            out["n_lines"] += 1
            digest = hashlib.blake2b(line, digest_size=16).digest()
            out["n_dup_lines"] += digest in seen
            seen.add(digest)
    word = np.concatenate(words)
    _count_repeats(out, word, np.zeros(len(word), np.uint64))
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text."""
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            buf, at = text_buffer(part.column(1))
            got = count_texts(buf, at) if len(buf) <= bw.LONG else count_long(buf)  # a long text comes alone
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *[pa.array(got[c].astype(np.int64)) for c in COUNTS]], ["doc_id", "lang", "source", *COUNTS])

    return read.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> list[Column]:
    """Transformed rates; a few words' worth of a usual text keeps those of short texts still."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    return [
        F.log((c["word_chars"] + 150) / (c["n_words"] + 30)) * 4,
        F.log((c["n_symbols"] + 1) / (c["word_chars"] + 200)),
        F.sqrt(c["n_dup_lines"] / (c["n_lines"] + 4)) * 2,
        F.sqrt(c["n_repeat_words"] / (c["n_words"] + 40)) * 2,
        F.log((c["n_upper"] + 8) / (c["word_chars"] + 200)),
        F.sqrt(c["n_stutters"] / (c["n_words"] + 10)) * 3,
    ]


DIMS = 6


def chi_square(level: float, n: int = DIMS) -> float:
    """The value that a chi-square law of ``n`` (even) degrees exceeds with chance ``level``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for k in range(1, n // 2):
            term *= x / 2 / k
            total += term
        low, high = (x, high) if np.exp(-x / 2) * total > level else (low, x)
    return low


def regularised(scatter: np.ndarray, rows: np.ndarray | float, spread: np.ndarray) -> np.ndarray:
    """The scatter of so many rows with the corpus' spread (variances) and the floor mixed in."""
    rows = np.asarray(rows, float)[..., None, None]
    return (rows * scatter + PRIOR * np.diag(spread)) / (rows + PRIOR) + FLOOR * np.eye(len(spread))


def _nearest(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, h: int) -> np.ndarray:
    y = x - mean
    return np.argpartition(np.einsum("ni,ij,nj->n", y, np.linalg.inv(scatter), y), h - 1)[:h]


def fast_mcd(x: np.ndarray, spread: np.ndarray, share: float = SHARE, starts: int = STARTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, plain scatter and logarithm of the determinant of the best subset found."""
    n, dims = x.shape
    h = int(np.ceil(share * n))
    rng = np.random.Generator(np.random.PCG64(seed))

    def of(rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = rows.mean(0)
        scatter = (rows - mean).T @ (rows - mean) / len(rows)
        return float(np.linalg.slogdet(regularised(scatter, len(rows), spread))[1]), mean, scatter

    def step(now: tuple) -> tuple:
        return of(x[_nearest(x, now[1], regularised(now[2], h, spread), h)])

    middle = np.median(x, 0)
    first = [(np.inf, middle, np.diag((1.4826 * np.median(np.abs(x - middle), 0)) ** 2))]
    first += [of(x[rng.choice(n, min(n, dims + 1), replace=False)]) for _ in range(starts)]
    best = sorted((step(step(s)) for s in first), key=lambda s: s[0])[:CARRIED]
    for i, now in enumerate(best):
        for _ in range(STEPS):
            after = step(now)
            if after[0] >= now[0] - 1e-9:
                break
            now = after
        best[i] = now
    logdet, mean, scatter = min(best, key=lambda s: s[0])
    return mean, scatter, logdet


_PARAMS = "grp string, mean array<double>, inv array<double>, logdet double, free double"


def _params(grp: pa.Array, mean: np.ndarray, scatter: np.ndarray, rows: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    """Means, inverse scatters, determinants, and how many dimensions' worth of spread is the rows' own."""
    whole = regularised(scatter, rows, spread)
    inverse = np.linalg.inv(whole)
    own = scatter * (rows / (rows + PRIOR))[:, None, None]
    free = np.einsum("nij,nji->n", own, inverse)
    lists = [pa.array(list(v.reshape(len(v), -1)), pa.list_(pa.float64())) for v in (mean, inverse)]
    return pa.RecordBatch.from_arrays([grp, *lists, pa.array(np.linalg.slogdet(whole)[1]), pa.array(free)], ["grp", "mean", "inv", "logdet", "free"])


def _started(sampled: DataFrame, spread: np.ndarray, share: float) -> DataFrame:
    """An estimate of each group from the rows here, a few thousand of each at most."""

    def run(table: pa.Table) -> pa.Table:
        x = np.stack(table["x"].combine_chunks().flatten().to_numpy().reshape(-1, DIMS))
        x = x[np.lexsort(x.T)]  # whatever order they came in
        mean, scatter, _ = fast_mcd(x, spread, share)
        return pa.Table.from_batches([_params(table["grp"][:1].combine_chunks(), mean[None], scatter[None], np.array([np.ceil(share * len(x))]), spread)])

    return sampled.select("grp", "x").groupBy("grp").applyInArrow(run, _PARAMS)


def _attach(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """Broadcast only where the number of groups was counted and is small."""
    return rows.join(F.broadcast(params) if n <= _BROADCAST_GROUPS else params, "grp")


def _moments(weighed: DataFrame) -> DataFrame:
    x, w = F.col("x"), F.col("w")
    cells = [(F.sum(w * x[i] * x[j]) / F.sum(w)).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return weighed.groupBy("grp").agg(F.sum(w).alias("n"), *[(F.sum(w * x[i]) / F.sum(w)).alias(f"m{i}") for i in range(DIMS)], *cells)


def _estimated(moments: DataFrame, spread: np.ndarray) -> DataFrame:
    """Parameters from moments: a small matrix for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names)}
            n = batch.num_rows
            mean = np.stack([got[f"m{i}"] for i in range(DIMS)], 1) if n else np.zeros((0, DIMS))
            scatter = np.zeros((n, DIMS, DIMS))
            for i in range(DIMS):
                for j in range(i, DIMS):
                    scatter[:, i, j] = scatter[:, j, i] = got[f"s{i}{j}"] - mean[:, i] * mean[:, j]
            yield _params(batch.column(0), mean, scatter, got["n"].astype(float), spread)

    return moments.mapInArrow(run, _PARAMS)


def _distance2() -> Column:
    y = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        total = total + y[i] * y[i] * F.col("inv")[i * DIMS + i]
        for j in range(i + 1, DIMS):
            total = total + 2 * y[i] * y[j] * F.col("inv")[i * DIMS + j]
    return total


def _level(d2: Column) -> Column:
    """Squared distances on the scale whose histogram is taken."""
    return F.log(d2 + LEAST_D2)


def _bin(value: Column) -> Column:
    return F.ceil(value / STEP).cast("long")


def _quantile(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """``by, bin, part``: the bin of ``v`` in which the share of each group's rows is reached, and what part of its rows it takes.

    A histogram combined before the shuffle; a window sees the bins of a group, about a
    thousand, however many rows it has.
    """
    bins = rows.groupBy(*by, _bin(F.col("v")).alias("bin")).agg(F.count("*").alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy(*by)) * share
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy("bin"))
    here = bins.withColumns({"whole": whole, "upto": upto}).where(F.col("upto") >= F.col("whole"))
    first = here.groupBy(*by).agg(F.min(F.struct("bin", "rows", "upto", "whole")).alias("b"))
    return first.select(*by, F.col("b.bin").alias("bin"), (1 - (F.col("b.upto") - F.col("b.whole")) / F.col("b.rows")).alias("part"))


def _medians(rows: DataFrame) -> np.ndarray:
    """Of ``(dim, v)``; zeros where there are no rows."""
    out = np.zeros(DIMS)
    for r in _quantile(rows, ["dim"], 0.5).collect():
        out[r["dim"]] = r["bin"] * STEP
    return out


def _spread(points: DataFrame) -> np.ndarray:
    """Robust variances of the statistics over the whole corpus."""
    mid = _medians(points.select(F.posexplode("x").alias("dim", "v")))
    off = F.transform(F.col("x"), lambda v, i: F.abs(v - F.get(F.array(*map(F.lit, mid.tolist())), i)))
    return (1.4826 * _medians(points.select(F.posexplode(off).alias("dim", "v")))) ** 2


def _concentrated(points: DataFrame, params: DataFrame, n: int, spread: np.ndarray, share: float) -> DataFrame:
    """One step over all rows: each group's estimate from the rows nearest to ``params``."""
    near = _attach(points.select("grp", "x"), params, n).select("grp", "x", _bin(_level(_distance2())).alias("bin"), _level(_distance2()).alias("v"))
    edge = _quantile(near, ["grp"], share).withColumnRenamed("bin", "edge")
    core = _attach(near, edge, n).where(F.col("bin") <= F.col("edge"))
    return _estimated(_moments(core.withColumn("w", F.when(F.col("bin") < F.col("edge"), 1.0).otherwise(F.col("part")))), spread)


def estimates(points: DataFrame, sizes: DataFrame, n: int, share: float = SHARE, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """Parameters of each group of ``points(grp, x, place)``, whose rows are counted in ``sizes(grp, n)``."""
    spread = _spread(points)
    # "place" is uniform in 2**30; a group's rows are all taken or about ``sample`` of them
    some = _attach(points, sizes, n).where(F.col("place") * F.col("n") < F.lit(float(sample) * 2**30))
    start = cut(_started(some, spread, share).join(sizes, "grp"))
    held = start.where(F.col("n") <= sample).drop("n")
    now = start.where(F.col("n") > sample).drop("n").withColumn("logdet", F.lit(float("inf")))
    for _ in range(STEPS):
        if now.isEmpty():
            break
        after = _concentrated(points, now, n, spread, share).select(*[F.col(c).alias(f"new_{c}" if c != "grp" else c) for c in ("grp", "mean", "inv", "logdet", "free")])
        both = cut(now.join(after, "grp").withColumn("falls", F.col("new_logdet") < F.col("logdet") - FALL))
        held = held.unionByName(both.where(~F.col("falls")).select(*now.columns))
        now = both.where("falls").select("grp", *[F.col(f"new_{c}").alias(c) for c in now.columns if c != "grp"])
    return cut(held.unionByName(now)), spread


def robust_outliers(docs: DataFrame, level: float = LEVEL, share: float = SHARE, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is null where the base rule failed.
    """
    stats = cut(statistics(docs, id_col, text_col, lang_col, source_col))
    # "s:" and "n:" tell values from nulls
    tag = lambda c: F.when(F.col(c).isNull(), "n:").otherwise(F.concat(F.lit("s:"), F.col(c)))
    grp = F.to_json(F.struct(tag("lang").alias("l"), tag("source").alias("s")))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**30))  # stable, as the counts lie in the shared folder
    points = stats.select(grp.alias("grp"), F.array(*features()).alias("x"), place.alias("place"), base_failed().alias("failed"))
    points = cut(points.where(~F.col("failed")).drop("failed"))
    sizes = cut(points.groupBy("grp").agg(F.count("*").alias("n")))
    n = sizes.count()
    params, _ = estimates(points, sizes, n, share, sample)
    # scale: the median squared distance becomes that of the chi-square law of the free dimensions
    middle = _quantile(_attach(points, params, n).select("grp", _level(_distance2()).alias("v")), ["grp"], 0.5)
    mid2 = middle.select("grp", (F.exp(F.col("bin") * STEP) - LEAST_D2).alias("mid2"))
    free = F.greatest("free", F.lit(1.0))
    typical = free * F.pow(1 - 2 / (9 * free), 3)
    scaled = cut(params.join(mid2, "grp").select("grp", "mean", "inv", F.greatest(F.col("mid2") / typical, F.lit(1.0)).alias("c")))

    named = stats.withColumns({"base_failed": base_failed(), "grp": grp, "x": F.array(*features())})
    final = F.broadcast(scaled) if n <= _BROADCAST_GROUPS else scaled
    out = named.join(final, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance2(), F.lit(0.0)) / F.col("c"))))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= float(np.sqrt(chi_square(level))))).alias("kept"))
