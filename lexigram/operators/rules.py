"""Filters over attributes and prefixes, as Catalyst-visible predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigram.config import attr_column


def cnf(rules: list[list[dict]]) -> Column:
    """All of the clauses, any literal of a clause.

    A literal is ``{"attr": name, "op": "==" or "!=", "value": text}``; a missing attribute
    equals no value.
    """
    whole = F.lit(True)
    for clause in rules:
        if not clause:
            raise ValueError("an empty clause can't hold")
        literals = []
        for lit in clause:
            column, op, value = F.col(attr_column(lit["attr"])), lit.get("op", "=="), lit["value"]
            if op not in ("==", "!="):
                raise ValueError(f"unknown operator {op!r}")
            same = column == value
            literals.append(F.coalesce(same, F.lit(False)) if op == "==" else ~F.coalesce(same, F.lit(False)))
        whole = whole & reduce(lambda a, b: a | b, literals)
    return whole


def holds(rules: list[list[dict]], values: dict) -> bool:
    """The same of plain values."""
    return all(any((values.get(lit["attr"]) == lit["value"]) == (lit.get("op", "==") == "==") for lit in clause) for clause in rules)


def any_prefix(column: str, prefixes: list[str]) -> Column:
    if not prefixes:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes])
