"""Named queries over the tables, with the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigram.functions.text import tokens
from lexigram.operators import aggregate
from lexigram.operators.blocks import count_blocks
from lexigram.operators.rules import any_prefix, cnf
from lexigram.operators.runs import count_runs
from lexigram.operators.store import export_lines, scratch
from lexigram.operators.windows import array_windows, names, stream_windows
from lexigram.plans.search import SearchArgs, matching, search
from lexigram.sources.readers import spread, table_stream, table_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The tokens of every document, as SQL.
_TOKENS = r"""
with t0 as (select doc_id, lang, source, list_filter(
    regexp_split_to_array(lower(text), '[,.\t\n\f\r ;?!:]+'), lambda x: x <> '') t
  from documents),
tk as materialized (select doc_id, lang, source, unnest(t) tok, generate_subscripts(t, 1) - 1 pos from t0)
"""
#: Windows of so many tokens are shuffled in runs.
LONG = 4
STOP, IGNORE = ["the", "die", "la", "de"], ["of", "and", "und", "et", "y"]


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _windows(docs: DataFrame, n: int, **more) -> DataFrame:
    return array_windows(docs, n, tokens(F.col("text")), **more)


def _tok(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.lower("text").alias("tok"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word dictionary, stored, since it is read more than once: the documents are read for it once."""
    words = scratch(spark)
    _index(spark, sf_dir, 1).select(F.col("t1").alias("word")).write.parquet(f"{words}/found")
    aggregate.dense_ids(spark.read.schema("word string").parquet(f"{words}/found"), [F.col("word")]).write.parquet(f"{words}/numbered")
    return spark.read.schema("word string, id long").parquet(f"{words}/numbered")


def _index(spark: SparkSession, sf_dir: str, n: int = 3, min_freq: int = 0) -> DataFrame:
    if n >= LONG:
        return count_runs(_docs(spark, sf_dir), n, tokens(F.col("text")), min_freq)
    return count_blocks(_tok(_docs(spark, sf_dir)), n, min_freq)


def _leads(n: int) -> str:
    return ", ".join(["tok as t1", *[f"lead(tok, {i}) over w as t{i + 1}" for i in range(1, n)]])


def _grams(n: int, source: str = "tk", key: str = "doc_id", where: str = "") -> str:
    """SQL for ``g(t1..tn, count)`` after the tokens."""
    cols = ", ".join(names(n))
    rows = f"select {key}, pos, {_leads(n)} from {source} window w as (partition by {key} order by pos)"
    return f"w0 as ({rows}), g as materialized (select {cols}, count(*) as count from w0 where t{n} is not null {where} group by {cols})"


_G2, _G3 = _grams(2), _grams(3)
_DICT = "d as materialized (select word, row_number() over (order by word) - 1 as id from (select distinct tok as word from tk))"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_index(spark, sf_dir, 2, 2), SearchArgs("th*"))


@query(f"{_TOKENS} select tok, count(*) as count from tk group by tok")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_tokens(_docs(spark, sf_dir)).groupBy("tok").agg(F.count("*").alias("count"))


def _sized(n: int) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _index(spark, sf_dir, n)

    QUERIES[f"ngrams_{n}"] = f
    ORACLE_SQL[f"ngrams_{n}"] = f"{_TOKENS}, {_grams(n)} select * from g"


for _n in range(1, 11):
    _sized(_n)


@query(f"{_TOKENS}, {_G3} select * from g where count >= 4")
def min_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, 3, 4)


_STOPPED = f"""{_TOKENS},
s0 as (select *, sum(case when tok in ({", ".join(f"'{s}'" for s in STOP)}) then 1 else 0 end)
    over (partition by doc_id order by pos rows between unbounded preceding and current row) seg from tk),
s1 as (select * from s0 where tok not in ({", ".join(f"'{s}'" for s in STOP + IGNORE)})),
w0 as (select doc_id, pos, lang, tok as t1, lead(tok, 1) over w as t2, lead(tok, 2) over w as t3
    from s1 window w as (partition by doc_id, seg order by pos))
"""


@query(f"""{_STOPPED} select t1, t2, t3, count(*) as count, arg_min(lang, {{'d': doc_id, 'p': pos}}) as lang
    from w0 where t3 is not null group by t1, t2, t3""")
def stop_ignore_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(_docs(spark, sf_dir), 3, keep=[F.col("doc_id"), F.col("lang")], stop=STOP, ignore=IGNORE)
    return aggregate.count_windows(w, 3, 0, ["lang"], ["doc_id"])


@query(f"{_TOKENS}, {_G3} select * from g where t1 = 'on'")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_index(spark, sf_dir), SearchArgs("on"))


@query(f"{_TOKENS}, {_G3} select * from g where starts_with(t1, 'th')")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_index(spark, sf_dir), SearchArgs("th*"))


@query(f"{_TOKENS}, {_G3} select * from g where false")
def search_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_index(spark, sf_dir), SearchArgs("nosuchword"))


def _regexp(name: str, pattern: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching(_index(spark, sf_dir), SearchArgs(pattern, "regexp"))

    QUERIES[name], ORACLE_SQL[name] = f, f"{_TOKENS}, {_G3} select * from g where {sql}"


_regexp("search_regexp", "th.* [aeo].*", "regexp_matches(t1, '^th.*$') and regexp_matches(t2, '^[aeo].*$')")
_regexp("regexp_three_tokens", "th.* .*n e.", "regexp_matches(t1, '^th.*$') and regexp_matches(t2, '^.*n$') and regexp_matches(t3, '^e.$')")
_regexp("regexp_alternation", "th|oe", "regexp_matches(t1, '^t(?:h|o)e$')")
_regexp("regexp_groups", "(the)|(and)", "regexp_matches(t1, '^(?:the|and)$')")
_regexp("regexp_class", "[ti]n.*", "regexp_matches(t1, '^[ti]n.*$')")
_regexp("regexp_optional", "ones?", "regexp_matches(t1, '^ones?$')")
_regexp("regexp_plus", "(th)+e", "regexp_matches(t1, '^(?:th)+e$')")
_regexp("regexp_star", "on(th)*.*", "regexp_matches(t1, '^on(?:th)*.*$')")


@query(f"{_TOKENS}, {_G3} select * from g where regexp_matches(t1, '^th[ea].*$')")
def regexp_without_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_index(spark, sf_dir), SearchArgs("th[ea].*", "regexp"), use_candidates=False)


@query(f"{_TOKENS}, {_G3} select * from g order by t1, t2, t3 limit 10 offset 5")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_index(spark, sf_dir), SearchArgs("*", offset=5, limit=10))


@query(f"{_TOKENS}, {_G3} select * from g where starts_with(t1, 'on') order by t1, t2, t3 offset 100")
def page_offset_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_index(spark, sf_dir), SearchArgs("on*", offset=100))


@query(f"""{_TOKENS}, s1 as (select * from tk where tok not in ({", ".join(f"'{s}'" for s in IGNORE)})), {_grams(2, "s1")} select * from g""")
def ignored_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_windows(_windows(_docs(spark, sf_dir), 2, ignore=IGNORE), 2)


@query(f"""{_TOKENS}, {_grams(2, where="and t1 not in ('the', 'die', 'la', 'de') and t2 not in ('the', 'die', 'la', 'de')")} select * from g""")
def stop_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_windows(_windows(_docs(spark, sf_dir), 2, stop=STOP), 2)


@query(f"""{_TOKENS}, w0 as (select doc_id, pos, lang, source, tok as t1, lead(tok, 1) over w as t2
      from tk window w as (partition by doc_id order by pos))
  select t1, t2, count(*) as count, arg_min(source, doc_id) as source, arg_min(lang, doc_id) as lang
  from w0 where t2 is not null and t1 = 'on' group by t1, t2""")
def search_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    w = _windows(docs, 2, keep=[F.col("doc_id"), F.col("lang"), F.col("source")])
    index = aggregate.count_windows(w, 2, 0, ["lang", "source"], ["doc_id"])
    return matching(index, SearchArgs("on", attrs=["source", "lang"]))


@query(f"{_TOKENS} select word, row_number() over (order by word) - 1 as id from (select distinct tok as word from tk)")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.word_dictionary(table_tokens(_docs(spark, sf_dir)))


@query(f"""{_TOKENS} select word, id from (select word, row_number() over (order by word) - 1 as id
    from (select distinct tok as word from tk)) where starts_with(word, 'er')""")
def words_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.word_dictionary(table_tokens(_docs(spark, sf_dir))).where(F.col("word").startswith("er"))


@query(f"""{_TOKENS} select word, id from (select word, row_number() over (order by word) - 1 as id
    from (select distinct tok as word from tk)) where word = 'of'""")
def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.word_dictionary(table_tokens(_docs(spark, sf_dir))).where(F.col("word") == "of")


@query(f"{_TOKENS}, {_DICT}, {_G2} select a.id as id1, b.id as id2, g.count from g join d a on a.word = t1 join d b on b.word = t2")
def encoded_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    coded = aggregate.encode(aggregate.encode(_index(spark, sf_dir, 2), words, "t1", "id1"), words, "t2", "id2")
    return coded.select("id1", "id2", "count")


@query(f"{_TOKENS}, {_DICT}, {_G2} select a.id as id1, t2, count from g join d a on a.word = t1 where a.id between 100 and 120")
def ngrams_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    coded = aggregate.encode(_index(spark, sf_dir, 2), words, "t1", "id1")
    return coded.where(F.col("id1").between(100, 120)).select("id1", "t2", "count")


@query(f"{_TOKENS}, {_G2} select t1, t2, count from g where t1 = 'on'")
def decoded_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    coded = aggregate.encode(aggregate.encode(matching(_index(spark, sf_dir, 2), SearchArgs("on")), words, "t1", "i1"), words, "t2", "i2")
    plain = coded.select("i1", "i2", "count")
    return aggregate.decode(aggregate.decode(plain, words, "i1", "t1"), words, "i2", "t2").select("t1", "t2", "count")


@query("""select source as value, row_number() over (order by min(doc_id), source) - 1 as id from documents group by source""")
def attr_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.attribute_dictionary(_docs(spark, sf_dir).select("source", "doc_id"), "source", ["doc_id"])


@query(f"{_TOKENS}, {_G3} select count(distinct t1) as level1, (select count(*) from (select distinct t1, t2 from g)) as level2, count(*) as level3 from g")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.levels(_index(spark, sf_dir), 3)


@query(f"{_TOKENS}, {_G3} select count(*) as size from g where starts_with(t1, 'th')")
def result_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_index(spark, sf_dir), SearchArgs("th*")).agg(F.count("*").alias("size"))


@query(f"{_TOKENS}, {_G3} select * from g where t1 in (select distinct tok from tk where starts_with(tok, 'on'))")
def ngrams_semi_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = aggregate.vocabulary(table_tokens(_docs(spark, sf_dir))).where(F.col("word").startswith("on"))
    return _index(spark, sf_dir).join(words.withColumnRenamed("word", "t1"), "t1", "left_semi").select("t1", "t2", "t3", "count")


@query(f"{_TOKENS}, {_G3} select * from g where t1 = 'on' union all select * from g where t1 = 'the'")
def union_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return matching(index, SearchArgs("on")).unionByName(matching(index, SearchArgs("the")))


@query(f"""{_TOKENS}, ft as (select * from tk where (lang = 'en' or lang = 'de') and source <> 'src0'), {_grams(2, "ft")} select * from g""")
def struct_filter_cnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [[{"attr": "lang", "value": "en"}, {"attr": "lang", "value": "de"}], [{"attr": "source", "op": "!=", "value": "src0"}]]
    return aggregate.count_windows(_windows(_docs(spark, sf_dir).where(cnf(rules)), 2), 2)


@query(f"{_TOKENS}, {_grams(2, where='and length(t1) >= 4 and length(t2) >= 4')} select * from g")
def custom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    accept = lambda words, tags: (F.char_length(words[0]) >= 4) & (F.char_length(words[1]) >= 4)
    return aggregate.count_windows(_windows(_docs(spark, sf_dir), 2, accept=accept), 2)


@query(f"""{_TOKENS}, tg as (select *, case when length(tok) <= 3 then 'S' else 'L' end as tag from tk),
  w0 as (select tok as t1, lead(tok) over w as t2, tag as g1, lead(tag) over w as g2 from tg window w as (partition by doc_id order by pos))
  select t1, t2, count(*) as count from w0 where g1 = 'S' and g2 = 'L' group by t1, t2""")
def custom_filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.transform(tokens(F.col("text")), lambda t: F.when(F.char_length(t) <= 3, "S").otherwise("L"))
    accept = lambda words, tags: (tags[0] == "S") & (tags[1] == "L")
    return aggregate.count_windows(_windows(_docs(spark, sf_dir), 2, tags=tags, accept=accept), 2)


@query(f"{_TOKENS}, {_grams(2, where=chr(32) + 'and (starts_with(t1, chr(116)) or starts_with(t1, chr(105)))')} select * from g")
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_windows(_windows(_docs(spark, sf_dir), 2).where(any_prefix("t1", ["t", "i"])), 2)


@query(f"{_TOKENS}, {_G2} select concat_ws(chr(9), t1, t2, count) as line from g where count >= 4 order by t1, t2")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_lines(_index(spark, sf_dir, 2), 4)


@query(r"""with t0 as (select conv_id, turn, role, list_filter(
    regexp_split_to_array(lower(text), '[,.\t\n\f\r ;?!:]+'), lambda x: x <> '') t from conversations),
tk as (select conv_id, turn, role, unnest(t) tok, generate_subscripts(t, 1) - 1 pos from t0),
w0 as (select conv_id, turn, role, pos, tok as t1, lead(tok) over w as t2 from tk window w as (partition by conv_id, turn order by pos))
select t1, t2, count(*) as count, arg_min(role, {'c': conv_id, 't': turn}) as role from w0 where t2 is not null group by t1, t2""")
def conversation_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(_docs(spark, sf_dir, "conversations"), 2, keep=[F.col("conv_id"), F.col("turn"), F.col("role")])
    return aggregate.count_windows(w, 2, 0, ["role"], ["conv_id", "turn"])


@query(f"""{_TOKENS}, w0 as (select tok as t1, lead(tok) over (order by doc_id, pos) as t2 from tk)
  select t1, t2, count(*) as count from w0 where t2 is not null group by t1, t2""")
def cross_document_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_windows(stream_windows(table_stream(_docs(spark, sf_dir)), 2, "file"), 2)


@query(f"{_TOKENS}, {_G2} select * from g where count >= 2 order by count desc, t1, t2 limit 25")
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, 2, 2).orderBy(F.desc("count"), "t1", "t2").limit(25)
