"""Searches of an index: exact, by prefix, by regular expressions, with paging."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigram.config import attr_column
from lexigram.operators.windows import names
from lexigram.plans import regexlang

QUERY_TYPES = ("default", "regexp")


@dataclass
class SearchArgs:
    """``limit`` under 0 means all rows; rows come in the order of their tokens."""

    query: str
    query_type: str = "default"
    attrs: list[str] = field(default_factory=list)
    offset: int = 0
    limit: int = -1
    lower_query: bool = False
    strict_compat: bool = False

    def __post_init__(self) -> None:
        if self.query_type not in QUERY_TYPES:
            raise ValueError(f"unknown query type {self.query_type!r}")
        if self.offset < 0:
            raise ValueError("the offset is negative")
        if not self.query:
            raise ValueError("the query is empty")


def index_n(index: DataFrame) -> int:
    n = 0
    while f"t{n + 1}" in index.columns:
        n += 1
    if not n or "count" not in index.columns:
        raise ValueError("not an n-gram index")
    return n


def predicate(args: SearchArgs, n: int, use_candidates: bool = True) -> Column:
    query = args.query.lower() if args.lower_query else args.query
    if args.query_type == "default":
        if query.endswith("*"):
            return F.col("t1").startswith(query[:-1]) if query != "*" else F.lit(True)
        return F.col("t1") == query
    parts = query.split(" ")
    if len(parts) > n:
        raise ValueError(f"{len(parts)} patterns for n-grams of {n}")
    tree = regexlang.parse(parts[0])
    tests = [F.col("t1").rlike(f"^(?:{regexlang.java(tree)})$")]
    if use_candidates:
        tests.insert(0, regexlang.candidate_predicate("t1", regexlang.candidates(tree)))
    tests += [F.col(f"t{i}").rlike(f"^{p}$" if args.strict_compat else f"^(?:{p})$") for i, p in enumerate(parts[1:], 2)]
    return reduce(lambda a, b: a & b, tests)


def matching(index: DataFrame, args: SearchArgs, use_candidates: bool = True) -> DataFrame:
    """All matching rows with the asked attributes, in the order they were asked for."""
    n = index_n(index)
    attrs = [attr_column(a) for a in args.attrs]
    unknown = [a for a, c in zip(args.attrs, attrs, strict=True) if c not in index.columns or c in (*names(n), "count")]
    if unknown:
        raise ValueError(f"unknown attributes: {unknown}")
    if args.query_type == "regexp":
        _check_patterns(index.sparkSession, args.query.split(" ")[1:])
    return index.where(predicate(args, n, use_candidates)).select(*names(n), "count", *attrs)


def _check_patterns(spark: SparkSession, patterns: list[str]) -> None:
    """The first pattern has a grammar of its own; the others are Java's, which fail here and not in a task."""
    for p in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
        except (Py4JJavaError, PySparkException):
            raise ValueError(f"wrong pattern {p!r}") from None


def search(index: DataFrame, args: SearchArgs) -> DataFrame:
    """One page of the matching rows, in the order of their tokens."""
    rows, order = matching(index, args), names(index_n(index))
    if args.limit >= 0:
        return rows.orderBy(*order).offset(args.offset).limit(args.limit)
    if args.offset:  # n-grams are distinct, so those after the last one left out follow; no row number passes one task
        last = rows.select(F.struct(*order).alias("k")).orderBy("k").limit(args.offset).offset(args.offset - 1)
        rows = rows.where(F.struct(*order) > last.scalar())
    return rows.orderBy(*order)


def as_results(rows: DataFrame) -> DataFrame:
    """``ngram, count, args`` as an answer has them."""
    n = index_n(rows)
    extra = [c for c in rows.columns if c not in (*names(n), "count")]
    args = F.array(*[F.col(c) for c in extra]) if extra else F.array().cast("array<string>")
    return rows.select(F.array(*names(n)).alias("ngram"), "count", args.alias("args"))


def results(rows: DataFrame) -> Iterator[dict]:
    """Rows of an answer one by one, a partition at a time."""
    for r in as_results(rows).toLocalIterator():
        yield {"ngram": list(r["ngram"]), "count": r["count"], "args": list(r["args"])}
