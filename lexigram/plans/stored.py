"""Queries over files: indices that are written and opened again, vertical and plain sources, builds from settings.

Each writes its input or its index to a new folder in the shared one, which is deleted when
the driver ends, and reads it back; the tables and the SQL are those of the catalogue.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigram import build, cli
from lexigram.config import BuildConf, SearchConf
from lexigram.functions import filters
from lexigram.functions.text import tokens
from lexigram.operators import aggregate
from lexigram.operators.blocks import count_blocks
from lexigram.operators.store import open_index, scratch, write_index
from lexigram.operators.windows import packed_windows
from lexigram.plans import catalogue as c
from lexigram.plans.search import SearchArgs, matching, results, search
from lexigram.server import answer
from lexigram.sources import packed


def _stored(spark: SparkSession, sf_dir: str, n: int = 3, attrs: bool = False, path: str = "") -> str:
    path = path or scratch(spark)
    keep = ["doc_id", "lang", "source"] if attrs else []
    write_index(count_blocks(c._tok(c._docs(spark, sf_dir), *keep), n, 0, keep[1:], "doc_id", ranges=True), path, dealt=True)
    return path


@c.query(f"{c._TOKENS}, {c._G3} select * from g where t1 = 'on'")
def stored_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(open_index(spark, _stored(spark, sf_dir)), SearchArgs("on"))


@c.query(f"{c._TOKENS}, {c._G3} select * from g where starts_with(t1, 'th')")
def stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(open_index(spark, _stored(spark, sf_dir)), SearchArgs("th*"))


@c.query(f"{c._TOKENS}, {c._G3} select * from g where regexp_matches(t1, '^th.*$') and regexp_matches(t2, '^[aeo].*$')")
def stored_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(open_index(spark, _stored(spark, sf_dir)), SearchArgs("th.* [aeo].*", "regexp"))


@c.query(f"{c._TOKENS}, {c._G3} select t1, count(*) as count from g group by t1")
def stored_first_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark, _stored(spark, sf_dir)).groupBy("t1").agg(F.count("*").alias("count"))


_ATTRS = f"""{c._TOKENS}, w0 as (select doc_id, pos, lang, source, tok as t1, lead(tok, 1) over w as t2
      from tk window w as (partition by doc_id order by pos)),
  g as (select t1, t2, count(*) as count, arg_min(source, doc_id) as source, arg_min(lang, doc_id) as lang from w0 where t2 is not null group by t1, t2)"""


@c.query(f"{_ATTRS} select t1, t2, count, source from g where t1 = 'on'")
def stored_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(open_index(spark, _stored(spark, sf_dir, 2, attrs=True), ["source"]), SearchArgs("on", attrs=["source"]))


@c.query(f"{c._TOKENS}, {c._G3} select t1, t2, t3, count from g where t1 = 'on' order by t1, t2, t3 limit 50 offset 7")
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search(open_index(spark, _stored(spark, sf_dir)), SearchArgs("on", offset=7, limit=50))
    return spark.createDataFrame([(*r["ngram"], r["count"]) for r in results(page)], "t1 string, t2 string, t3 string, count long")


_LINE = "'res[' || (row_number() over (order by t1, t2) - 1) || ']: ' || t1 || ' ' || t2 || ' (' || count || ', [''' || source || ''', ''' || lang || '''])'"


@c.query(f"{_ATTRS}, p as (select * from g where starts_with(t1, 'on') order by t1, t2 limit 40) select {_LINE} as line from p")
def command_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scratch(spark)
    _stored(spark, sf_dir, 2, attrs=True, path=f"{top}/corpus/ngrams")
    said = io.StringIO()
    with tempfile.NamedTemporaryFile("w", suffix=".json") as conf, contextlib.redirect_stdout(said):  # settings of the driver alone
        json.dump({"dataPath": top}, conf)
        conf.flush()
        cli.main(["-conf-path", conf.name, "-attrs", "source,lang", "-limit", "40", "search", "corpus", "on*"], spark)
    return spark.createDataFrame([(line,) for line in said.getvalue().splitlines()], "line string")


@c.query(f"{_ATTRS} select t1, t2, count, lang from g where regexp_matches(t1, '^th[ea].*$') order by t1, t2 limit 30 offset 3")
def http_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scratch(spark)
    _stored(spark, sf_dir, 2, attrs=True, path=f"{top}/corpus/ngrams")
    _, body = answer(spark, SearchConf(top), f"/search?corpus=corpus&q={quote('th[ea].*')}&qtype=regexp&attrs=lang&offset=3&limit=30")
    rows = json.loads("".join(body))["rows"]
    return spark.createDataFrame([(*r["ngram"], r["count"], *r["args"]) for r in rows], "t1 string, t2 string, count long, lang string")


# files


#: Bytes of documents (Parquet) that go to one file.
FILE_BYTES = 16 << 20


def _files(docs: DataFrame) -> int:
    return max(1, -(-int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // FILE_BYTES))


def _vertical(spark: SparkSession, sf_dir: str) -> str:
    """Documents as a vertical file, in the order of their ids: attributes, a head of three tokens, tags by length."""
    tok = tokens(F.col("text"))
    lines = F.transform(tok, lambda t: F.concat(t, F.lit("\t"), F.when(F.char_length(t) <= 3, "S").otherwise("L")))
    head = F.concat(F.lit("<head>\n"), F.array_join(F.concat(F.slice(lines, 1, 3), F.array(F.lit("</head>"))), "\n"))
    rest = F.array_join(F.concat(F.array(head), F.slice(lines, 4, 2**30), F.array(F.lit("</doc>"))), "\n")
    start = F.concat(F.lit('<doc lang="'), F.col("lang"), F.lit('" source="'), F.col("source"), F.lit('">\n'))
    path = f"{scratch(spark)}/corpus.vert"
    docs = c._docs(spark, sf_dir)
    # files of bounded size, since a task sorts the documents of its file
    files = max(spark.sparkContext.defaultParallelism, _files(docs))
    docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select(F.concat(start, rest).alias("value")).write.text(path)
    return path


def _conf(path: str, **more) -> BuildConf:
    return BuildConf.of({"inputFilePath": path, "sourceType": "vertical", "tagAttrIdx": 1, **more})


# the head is a structure of its own: windows don't cross its end
_HEADED = "hd as (select *, pos >= 3 as body from tk)"


def _headed(n: int, extra: str = "", source: str = "hd", more: str = "") -> str:
    cols = ", ".join(f"t{i}" for i in range(1, n + 1))
    return f"""{_HEADED}, {more} w0 as (select doc_id, pos, lang, source, body, {c._leads(n)} from {source} window w as (partition by doc_id, body order by pos)),
  g as (select {cols}, count(*) as count, arg_min(lang, {{'d': doc_id, 'p': pos}}) as doc_lang from w0 where t{n} is not null {extra} group by {cols})"""


@c.query(f"{c._TOKENS}, {_headed(2)} select * from g")
def vertical_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), args={"doc.lang": "col8"}), 2)


@c.query(f"{c._TOKENS}, {_headed(3)} select t1, t2, t3, count from g where count >= 2")
def vertical_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), useStrictStructParser=True, minNgramFreq=2), 3)


@c.query(f"{c._TOKENS}, {_headed(2, 'and body')} select t1, t2, count from g")
def vertical_ignored_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), ngramIgnoreStructs=["head"]), 2)


@c.query(f"""{c._TOKENS}, {_headed(2, "and (lang = 'en' or lang = 'de') and source <> 'src0'")} select t1, t2, count from g""")
def vertical_filter_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [[{"attr": "doc.lang", "value": "en"}, {"attr": "doc.lang", "value": "de"}], [{"attr": "doc.source", "op": "!=", "value": "src0"}]]
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), filterArgs=rules), 2)


@c.query(f"{c._TOKENS}, {_headed(2, 'and length(t1) <= 3 and length(t2) > 3')} select t1, t2, count from g")
def vertical_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters.register("short_then_long", lambda words, tags: (tags[0] == "S") & (tags[1] == "L"))
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), ngramFilter={"fn": "short_then_long"}), 2)


_NOT_IGNORED = "s1 as (select * from hd where tok not in ('of', 'and')),"


@c.query(f"""{c._TOKENS}, {_headed(2, "and t1 <> 'the' and t2 <> 'the'", 's1', _NOT_IGNORED)} select t1, t2, count from g""")
def vertical_stop_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.ngrams(spark, _conf(_vertical(spark, sf_dir), ngramStopStrings=["the"], ngramIgnoreStrings=["of", "and"]), 2)


@c.query(f"{c._TOKENS} select word, row_number() over (order by word) - 1 as id from (select distinct tok as word from tk)")
def built_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = build.build_index(spark, _conf(_vertical(spark, sf_dir)), 2)
    return spark.read.parquet(f"{where}/words")


@c.query(f"{c._TOKENS} select source as value, row_number() over (order by min(doc_id)) - 1 as id from tk group by source")
def built_attribute_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = build.build_index(spark, _conf(_vertical(spark, sf_dir), args={"doc.source": "col32"}), 2)
    return spark.read.parquet(f"{where}/attr_doc_source")


@c.query(f"{c._TOKENS}, {_headed(2)} select concat_ws(chr(9), t1, t2, count) as line from g where count >= 4")
def extracted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build.extract_ngrams(spark, _conf(_vertical(spark, sf_dir), minNgramFreq=4), 2)
    return spark.read.text(out).select(F.col("value").alias("line"))


def _plain(spark: SparkSession, sf_dir: str, charset: str = "utf-8", compression: str = "none") -> str:
    """All documents as one plain text, in the order of their ids: files of bounded size whose names follow it, since one task reads a packed file."""
    path = f"{scratch(spark)}/text"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.where("text is not null").repartitionByRange(_files(docs), "doc_id").sortWithinPartitions("doc_id")
    text, end = F.col("text"), "\n"
    if charset != "utf-8":
        text, end = F.encode(text, charset.upper()).cast("string"), "\n\0" if charset == "utf-16le" else "\n"
    rows.select(text.alias("value")).write.option("compression", compression).option("lineSep", end).text(path)
    return path


_CROSS = f"{c._TOKENS}, w0 as (select tok as t1, lead(tok) over (order by doc_id, pos) as t2 from tk) select t1, t2, count(*) as count from w0 where t2 is not null group by t1, t2"


def _plain_query(name: str, charset: str, compression: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _plain(spark, sf_dir, charset, compression)
        return aggregate.count_windows(packed_windows(packed.plain(spark, path, 2, charset, joined=True).rows, 2), 2)

    c.QUERIES[name], c.ORACLE_SQL[name] = f, _CROSS


_plain_query("plain_file", "utf-8", "none")
_plain_query("plain_gzip", "utf-8", "gzip")
_plain_query("plain_bzip2", "utf-8", "bzip2")
_plain_query("plain_latin1", "iso-8859-1", "gzip")
_plain_query("plain_utf16", "utf-16le", "none")
