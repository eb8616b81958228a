"""Named predicates over windows: words and tags of an n-gram before it is counted.

A predicate is either a function of Columns, which Catalyst sees, or a plain Python function
``f(words, tags) -> bool``, which runs on Arrow batches.  A build file names a Python module
and a function in it; the function is one of Columns unless it carries ``plain = True``.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFilter = Callable[[list[Column], list[Column]], Column]
_known: dict[str, ColumnFilter] = {}
#: Where modules of filters may be installed.
LIBRARY = "/usr/local/lib/lexigram"


def register(name: str, of_columns: ColumnFilter) -> None:
    _known[name] = of_columns


def register_python(name: str, accept: Callable[[list[str], list[str]], bool]) -> None:
    """For logic that Column expressions can't say; slower."""

    def of_columns(words: list[Column], tags: list[Column]) -> Column:
        @F.pandas_udf("boolean")
        def run(w: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series([bool(accept(list(a), list(b))) for a, b in zip(w, t, strict=True)])

        return run(F.array(*words), F.array(*tags) if tags else F.array().cast("array<string>"))

    _known[name] = of_columns


def load(lib: str, name: str) -> None:
    """Registers function ``name`` of the Python file ``lib``: as given, in the working folder, or in ``LIBRARY``."""
    places = [os.path.join(where, lib) if where else lib for where in ("", os.getcwd(), LIBRARY)]
    path = next((p for p in places if os.path.isfile(p)), None)
    if path is None:
        raise ValueError(f"no window filter library {lib!r}")
    spec = importlib.util.spec_from_file_location(f"lexigram_filter_{zlib.crc32(os.path.abspath(path).encode())}", path)
    module = sys.modules[spec.name] = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    accept = getattr(module, name, None)
    if not callable(accept):
        raise ValueError(f"{path} has no function {name!r}")
    if getattr(accept, "plain", False):
        cloudpickle.register_pickle_by_value(module)  # executors don't have the file
        register_python(name, accept)
    else:
        register(name, accept)


def named(name: str, lib: str = "") -> ColumnFilter | None:
    """The predicate of this name, from ``lib`` if one is named; no name means none."""
    if not name:
        return None
    if lib:
        load(lib, name)
    if name not in _known:
        raise ValueError(f"unknown window filter {name!r}")
    return _known[name]
