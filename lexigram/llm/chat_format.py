"""Chat transcripts by relational formatting: one row a conversation, Spark expressions only.

Turns are collected as structs and sorted; runs of adjacent turns of one role become one
message, whose texts an array aggregation joins with a separator; the messages are then
concatenated::

    <|im_start|>role\\ntext<|turn_sep|>text<|im_end|>\\n

``<|`` inside a text gets a backslash in between (``<\\|``, and one more where there are
some already), so control strings stand only where the template put them and every turn
can be read back.  Roles have backslash and line feed escaped.

Null texts and roles count as empty; null turns come first; turns of the same number are
ordered by role, then text; rows with a null ``conv_id`` form one conversation.  An empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|turn_sep|>"
#: Texts whose places are summed up together.
_CHUNK = 256
_END_RE, _SEP_RE = r"<\|im_end\|>\n", r"<\|turn_sep\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of each conversation.

    ``loss_spans`` are the places in ``formatted`` (code points, end exclusive) of the texts
    of ``loss_role``, one for each turn.
    """
    read = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    convs = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[F.greatest(i - 2, F.lit(0))]["role"]))
    convs = convs.withColumn("first", first)

    def message(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("first"), k + 1), F.size("turns") + 1)
        run = F.slice("turns", start, after - start)
        return F.struct(run[0]["role"].alias("role"), F.transform(run, lambda t: escape(t["text"])).alias("texts"))

    convs = convs.select("conv_id", F.transform("first", message).alias("messages"))
    body = F.transform("messages", lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"), F.array_join(m["texts"], SEP), F.lit(END)))

    # spans: lengths of all texts in order, each after its header or separator
    def pieces(m: Column) -> Column:
        head = F.char_length(F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n")))
        last = F.size(m["texts"]) - 1
        return F.transform(
            m["texts"],
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(len(SEP)).alias("before"),
                F.char_length(t).alias("chars"),
                F.when(i == last, len(END)).otherwise(0).alias("after"),
                (m["role"] == F.lit(loss_role)).alias("loss"),
            ),
        )

    # running sums in chunks, since an array that grows turn by turn is copied at every turn
    convs = convs.select("conv_id", F.array_join(body, "").alias("formatted"), F.flatten(F.transform("messages", pieces)).alias("pieces"))
    chunk = lambda k: F.slice("pieces", k * _CHUNK + 1, F.lit(_CHUNK))
    convs = convs.withColumn("chunks", F.when(F.size("pieces") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / _CHUNK).cast("int")), chunk)).otherwise(F.array(F.col("pieces"))))
    length = lambda p: p["before"] + p["chars"] + p["after"]
    sums = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda acc, p: acc + length(p)))
    begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    convs = convs.withColumn("begins", begins)

    zero = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["before"]
        span = F.array(F.struct(start.alias("start"), (start + p["chars"]).alias("end")))
        return F.struct((acc["at"] + length(p)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.flatten(F.transform("chunks", lambda c, k: F.aggregate(c, zero(F.col("begins")[k]), step, lambda acc: acc["spans"])))
    return convs.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` (array of role and text) and ``loss_text``, from formatted rows alone."""
    whole = F.split("formatted", _END_RE, -1)
    messages = F.slice(whole, F.lit(1), F.size(whole) - 1)

    def turns(m: Column) -> Column:
        line = F.locate("\n", m)
        role = _unescape_role(F.substring(m, F.lit(len(START) + 1), line - len(START) - 1))
        return F.transform(F.split(F.substring(m, line + 1, F.char_length(m)), _SEP_RE, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, turns)).alias("turns"), loss.alias("loss_text"))
