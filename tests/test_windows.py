import random

import pytest
from pyspark.sql import functions as F

from lexigram.functions import filters
from lexigram.functions.text import tokens
from lexigram.operators.aggregate import attribute_dictionary, count_windows, decode, dense_ids, encode, levels, word_dictionary
from lexigram.operators.windows import array_windows, names, stream_windows


def counted(seqs, n, stop=(), ignore=(), min_freq=0, accept=None):
    """Counts by walking every sequence of tokens with a buffer."""
    out = {}
    for seq in seqs:
        buf = []
        for tok in seq:
            if tok in ignore:
                continue
            if tok is None or tok in stop:
                buf = []
                continue
            buf = [*buf, tok][-n:]
            if len(buf) == n and "" not in buf and (accept is None or accept(buf)):
                out[tuple(buf)] = out.get(tuple(buf), 0) + 1
    return {k: v for k, v in out.items() if v >= max(1, min_freq)}


def rows_of(df, n):
    return {tuple(r[t] for t in names(n)): r["count"] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 10])
def test_arrays_and_streams_match_a_plain_counter(spark, n):
    rng = random.Random(n)
    seqs = [[rng.choice("aabbcde.,") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "doc_id long, toks array<string>")
    for stop, ignore, least in (([], [], 0), (["."], [","], 0), ([".", "a"], ["b"], 2)):
        want = counted(seqs, n, stop, ignore, least)
        made = array_windows(docs, n, F.col("toks"), keep=[F.col("doc_id")], stop=stop, ignore=ignore)
        assert rows_of(count_windows(made, n, least), n) == want
        flat = [(i, p, t) for i, s in enumerate(seqs) for p, t in enumerate([t for t in s if t not in ignore])]
        stream = spark.createDataFrame(flat, "file long, pos long, tok string")
        for block in (12, 1000):
            assert rows_of(count_windows(stream_windows(stream, n, "file", stop=stop, block=block), n, least), n) == want


def test_worked_example(spark):
    docs = spark.createDataFrame([(1, "a b . c , d e".split())], "doc_id long, t array<string>")
    got = rows_of(count_windows(array_windows(docs, 2, F.col("t"), stop=["."], ignore=[","]), 2), 2)
    assert got == {("a", "b"): 1, ("c", "d"): 1, ("d", "e"): 1}


def test_sizes_on_twelve_tokens(spark):
    docs = spark.createDataFrame([(1, [f"w{i}" for i in range(12)]), (2, ["x"]), (3, []), (4, None)], "doc_id long, t array<string>")
    for n in range(2, 11):
        assert array_windows(docs, n, F.col("t")).count() == 13 - n
    with pytest.raises(ValueError):
        array_windows(docs, 11, F.col("t"))
    with pytest.raises(ValueError):
        array_windows(docs, 0, F.col("t"))


def test_empty_and_null_tokens_hold_no_window(spark):
    docs = spark.createDataFrame([(1, ["a", "", "b", "c", None, "d", "e"])], "doc_id long, t array<string>")
    assert set(rows_of(count_windows(array_windows(docs, 2, F.col("t")), 2), 2)) == {("b", "c"), ("d", "e")}


def test_tokens(spark):
    df = spark.createDataFrame([("Lorem ipsum, DOLOR.\tsit;amet?! a:b  ",), ("",), ("...",), (None,)], "text string")
    assert [r[0] for r in df.select(tokens(F.col("text"))).collect()] == [["lorem", "ipsum", "dolor", "sit", "amet", "a", "b"], [], [], None]


def test_first_attribute_wins(spark):
    docs = spark.createDataFrame([(2, ["a", "b"], "later"), (1, ["a", "b"], None), (3, ["c", "d"], "z")], "doc_id long, t array<string>, lang string")
    w = array_windows(docs, 2, F.col("t"), keep=[F.col("doc_id"), F.col("lang")])
    got = {(r["t1"], r["t2"]): (r["count"], r["lang"]) for r in count_windows(w, 2, 0, ["lang"], ["doc_id"]).collect()}
    assert got == {("a", "b"): (2, None), ("c", "d"): (1, "z")}
    with pytest.raises(ValueError):
        count_windows(w, 2, 0, ["lang"])


def test_filters_see_words_and_tags(spark):
    docs = spark.createDataFrame([(1, ["a", "x", "b", "c"], ["D", "I", "N", "V"])], "doc_id long, t array<string>, g array<string>")
    filters.register("noun_first", lambda words, tags: tags[0] == "N")
    filters.register_python("py_noun_first", lambda words, tags: tags[0] == "N" and len(words) == 2)
    for name in ("noun_first", "py_noun_first"):
        got = array_windows(docs, 2, F.col("t"), ignore=["x"], tags=F.col("g"), accept=filters.named(name))
        assert [(r["t1"], r["t2"]) for r in got.collect()] == [("b", "c")]
    stream = docs.select("doc_id", F.posexplode(F.arrays_zip("t", "g")).alias("pos", "x")).select("doc_id", "pos", F.col("x.t").alias("tok"), F.col("x.g").alias("tag"))
    got = stream_windows(stream, 2, "doc_id", accept=filters.named("py_noun_first"), tag="tag").collect()
    assert [(r["t1"], r["t2"]) for r in got] == [("b", "c")]
    assert filters.named("") is None
    with pytest.raises(ValueError):
        filters.named("nothing")


def test_dictionaries(spark):
    words = ["b", "a", "Z", "ž", "z", "ab", "abc", "abcd", "￿", "\U0001f600", "b"]
    toks = spark.createDataFrame([(w,) for w in words], "tok string")
    got = {r["word"]: r["id"] for r in word_dictionary(toks).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    rows = spark.createDataFrame([(5, "x"), (300_000, "y"), (1, "z"), (7, "x"), (9, None)], "doc_id long, v string")
    assert {r["value"]: r["id"] for r in attribute_dictionary(rows, "v", ["doc_id"]).collect()} == {"z": 0, "x": 1, None: 2, "y": 3}
    d = word_dictionary(toks)
    coded = encode(spark.createDataFrame([("a",), ("none",)], "w string"), d, "w", "i")
    assert {r["w"]: r["i"] for r in coded.collect()} == {"a": got["a"], "none": -1}
    assert {r["i"]: r["back"] for r in decode(coded.select("i"), d, "i", "back").collect()} == {got["a"]: "a", -1: None}
    assert dense_ids(toks.limit(0), [F.col("tok")]).count() == 0


def test_levels(spark):
    index = spark.createDataFrame([("a", "b", "c", 1), ("a", "b", "d", 1), ("a", "c", "c", 1), ("b", "b", "c", 1)], "t1 string, t2 string, t3 string, count long")
    assert tuple(levels(index, 3).first()) == (2, 3, 4)


def test_many_ids_run_through_ranges(spark, monkeypatch):
    from lexigram.operators import aggregate

    monkeypatch.setattr(aggregate, "_PER_RANGE", 2)
    words = sorted({f"https://www.{i * i % 3001}" for i in range(900)} | {"", "~"})
    got = dense_ids(spark.createDataFrame([(w,) for w in words], "w string"), [F.col("w")])
    assert {r["w"]: r["id"] for r in got.collect()} == {w: i for i, w in enumerate(words)}
