"""Secrets in texts: patterns that stand alone, and multipart credentials by an interval join.

Strong spans (``assign``, ``access``, ``hex``) are always reported.  Weak candidates are
not secrets by themselves: a login name (``login``), a mixed key of 20 characters or more without
a name (``key``), a password inside an address (``userinfo``).  They are reported only where
complementary parts meet in a scope: every identifier (an access id or a login) opens one that
reaches ``SCOPE`` code points to both sides, and so does every endpoint.

- a ``key`` is reported inside the scope of an identifier,
- a ``login`` inside the scope of a strong secret or a reported key,
- a ``userinfo`` where it overlaps the scope of its endpoint and a login or access id, or holds
  one before the colon itself.

Parts are rows ``(row, role, start, end)``; scopes are dealt into buckets as long as the
scope, and semi-joined on row and bucket with the exact overlap, so no pairs are emitted.
``row`` is 128 bits of hashes of id and text, so it is the same in every pass over the documents.

Null texts count as empty and have no span; null ids and repeated rows stay as rows of their
own; an empty table gives an empty result.  Other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigram.llm.common import cut, fresh, slices

SCOPE = 200
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "login", "key", "userinfo")
#: Rows with links, and links in all, that are broadcast at most.
_BROADCAST_ROWS, _BROADCAST_SPANS = 50_000, 500_000


def _either(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_ASSIGN = re.compile(f"({_either('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # runs are taken whole, so shorter ones needn't be found
_LOGIN = re.compile(f"(?:{_either('user|username|login|client_?id|access_?key(?:_?id)?|account(?:_?name)?')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@._-]{{3,}})")
# runs are taken whole, however long; one behind "=" counts too, since padding and a name's sign look alike
_KEY = re.compile("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}")
_ADDRESS = re.compile("[A-Za-z][A-Za-z0-9+.-]*://[^\\s\"'<>]+")
_USERINFO = re.compile("://([^/\\s:@]*):([^/\\s@]+)@")


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that stand alone, ordered by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates and endpoints, for texts where an identifier or an endpoint makes them matter."""
    logins = [("login", *m.span(1)) for m in _LOGIN.finditer(text)] if ":" in text or "=" in text else []
    out = []
    if "://" in text:
        out += [("endpoint", *m.span()) for m in _ADDRESS.finditer(text)]
        out += [("userinfo", *m.span(2)) for m in _USERINFO.finditer(text)]
        logins += [("login", *m.span(1)) for m in _USERINFO.finditer(text) if m[1]]
    if logins or any(s[0] == "access" for s in strong):
        taken = [s[1:] for s in strong]
        for m in _KEY.finditer(text):
            found = m[0]
            mixed = any(c.isdigit() for c in found) and any(c.islower() for c in found) and any(c.isupper() for c in found)
            if mixed and not any(a < m.end() and m.start() < b for a, b in taken):
                out.append(("key", *m.span()))
    return out + logins


def _row(doc_id: Column, text: Column) -> Column:
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


_SPAN = "struct<kind:string,start:int,end:int>"


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, strong, weak``: the spans of every whole text."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(_row(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2, limit=1 << 23):
            found, weak = [], []
            for text in part.column(2).to_pylist():
                spans = strong_spans(text)
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                weak.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in weak_parts(text, spans)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, span), pa.array(weak, span)], ["row", "doc_id", "strong", "weak"])

    return read.mapInArrow(run, f"row struct<a:long,b:long>, doc_id {kind}, strong array<{_SPAN}>, weak array<{_SPAN}>")


def _within(parts: DataFrame, scopes: DataFrame, scope: int) -> DataFrame:
    """The parts that overlap a scope around one of ``scopes`` in the same row."""
    around = scopes.select("row", (F.col("start") - scope).alias("low"), (F.col("end") + scope).alias("high"))
    around = around.select("row", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / scope), F.floor(F.col("high") / scope))).alias("bucket")).distinct()
    here = parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    meet = (here["row"] == around["row"]) & (here["bucket"] == around["bucket"]) & (here["start"] < around["high"]) & (around["low"] < here["end"])
    return here.join(around, meet, "left_semi").drop("bucket").distinct()


def link(extracted: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, kind, start, end`` of the weak candidates whose complementary parts co-occur."""
    shape = lambda c: extracted.select("row", F.explode(c).alias("s")).select("row", "s.*")
    weak, strong = shape("weak").distinct(), shape("strong").distinct()
    # rows without a weak part have nothing to link
    strong = strong.join(weak.select("row").distinct(), "row", "left_semi")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    identifiers = of(weak, "login").union(of(strong, "access"))
    keys = _within(of(weak, "key"), identifiers, scope)
    logins = _within(of(weak, "login"), keys.union(of(strong, "assign", "hex")).union(of(weak, "userinfo")), scope)
    userinfo = _within(_within(of(weak, "userinfo"), of(weak, "endpoint"), scope), identifiers, scope)
    return keys.union(logins).union(userinfo)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, strong, linked`` (arrays of spans)."""
    found = cut(extract(docs, id_col, text_col))
    linked = link(found, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    return found.join(linked, "row", "left").select("row", "doc_id", "strong", F.coalesce("linked", empty).alias("linked"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by ``mask``; null texts stay null."""
    found = cut(extract(docs, id_col, text_col))
    row, more = fresh(docs, "row"), fresh(docs, "linked")
    linked = cut(link(found, scope).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias(more)).withColumnRenamed("row", row))
    n_rows, n_spans = linked.agg(F.count("*"), F.sum(F.size(more))).first()
    side = F.broadcast(linked) if n_rows <= _BROADCAST_ROWS and (n_spans or 0) <= _BROADCAST_SPANS else linked
    keyed = docs.withColumn(row, _row(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(side, row, "left").select(*docs.columns, more)
    names = docs.columns
    at = names.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at, limit=1 << 23):
            out = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans = [] if text is None else sorted([s[1:] for s in strong_spans(text)] + [(m["start"], m["end"]) for m in more or []])
                if spans:
                    parts, end = [], 0
                    for a, b in spans:
                        if a >= end:
                            parts += [text[end:a], mask]
                        end = max(end, b)
                    text = "".join(parts) + text[end:]
                out.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)
