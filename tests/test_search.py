import re

import pytest

from lexigram.operators.store import export_lines, open_index, write_export, write_index
from lexigram.plans import regexlang
from lexigram.plans.search import SearchArgs, as_results, matching, predicate, results, search

CANDIDATES = [
    ("žluťoučký", ["žluťoučký"]),
    ("te[dxa]Z", ["tedZ", "texZ", "teaZ"]),
    ("(foo)", ["foo"]),
    ("(foo)|(bar)|(baz)", ["foo", "bar", "baz"]),
    ("foo|bar", ["fooar", "fobar"]),
    ("(foo)|([bB]ar)", ["foo", "bar", "Bar"]),
    ("abc?d", ["abcd", "abd"]),
    ("me(to)?dic", ["metodic", "medic"]),
    ("me(tada)?[Tt]a", ["metadaTa", "metadata", "meTa", "meta"]),
    ("me(tad[aA]x)?", ["metadax", "metadAx", "me"]),
    ("foo.+z", ["foo*"]),
    ("foo.*z", ["foo*"]),  # fooz lies under foo*
    ("ab*c", ["a*"]),
    ("ab+c", ["ab*"]),
]


@pytest.mark.parametrize(("pattern", "want"), CANDIDATES)
def test_candidates(pattern, want):
    assert regexlang.candidates(regexlang.parse(pattern)) == want


@pytest.mark.parametrize("pattern", ["[hxXH", "[hx(foo)H]", "foo)", "(foo", "", "a1", "a-b", "\\w", "[]", "a|", "*a", "()", "x{2}", "^a", "[a1]"])
def test_pattern_errors(pattern):
    with pytest.raises(regexlang.PatternError):
        regexlang.parse(pattern)


def test_candidates_never_lose_a_match():
    import random

    rng = random.Random(0)

    def made(depth=0):
        parts = []
        for _ in range(rng.randint(1, 3)):
            x = rng.choice(["a", "b", ".", "[ab]"]) if depth > 1 or rng.random() < 0.7 else f"({made(depth + 1)})"
            if rng.random() < 0.3:
                x += rng.choice("?*+")
            if rng.random() < 0.2:
                x += "|" + rng.choice("ab")
            parts.append(x)
        return "".join(parts)

    words = [""]
    for _ in range(5):
        words += [w + c for w in words if len(w) == len(words[-1]) for c in "abc"]
    for _ in range(300):
        tree = regexlang.parse(made())
        exact, found = re.compile(regexlang.java(tree)), regexlang.candidates(tree)
        for w in words:
            if exact.fullmatch(w):
                assert any(w == c or c.endswith("*") and w.startswith(c[:-1]) for c in found)


def test_many_candidates_become_a_prefix():
    assert regexlang.candidates(regexlang.parse("x" + "[abcde]" * 5)) == ["x*"]


ROWS = [("on", "the", "sea", 5, "x"), ("on", "a", "hill", 2, None), ("one", "by", "one", 7, "y"), ("the", "on", "off", 1, "z"), ("thee", "on", "x", 1, "z"), ("On", "the", "b", 1, "z")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("index")) + "/i"
    write_index(spark.createDataFrame(ROWS, "t1 string, t2 string, t3 string, count long, doc_file string"), where)
    return open_index(spark, where)


def first(df):
    return [tuple(r)[:3] for r in df.collect()]


def test_exact_prefix_and_case(index):
    assert first(search(index, SearchArgs("on"))) == [("on", "a", "hill"), ("on", "the", "sea")]
    assert len(first(search(index, SearchArgs("on*")))) == 3
    assert len(first(search(index, SearchArgs("*")))) == 6
    assert first(search(index, SearchArgs("nope"))) == first(search(index, SearchArgs("nope*"))) == []
    assert first(search(index, SearchArgs("On"))) == [("On", "the", "b")]
    assert len(first(search(index, SearchArgs("ON", lower_query=True)))) == 2


def test_regexps(index):
    assert first(search(index, SearchArgs("one?", "regexp"))) == [("on", "a", "hill"), ("on", "the", "sea"), ("one", "by", "one")]
    assert first(search(index, SearchArgs("on (the|a) .*l", "regexp"))) == [("on", "a", "hill")]
    assert first(search(index, SearchArgs("the+ on", "regexp"))) == [("the", "on", "off"), ("thee", "on", "x")]
    # a top-level bar in a later token: grouped, or as the two anchors have it
    assert first(search(index, SearchArgs("on a|th", "regexp"))) == [("on", "a", "hill")]
    assert len(first(search(index, SearchArgs("on a|th", "regexp", strict_compat=True)))) == 1
    with pytest.raises(ValueError):
        search(index, SearchArgs("a b c d", "regexp"))
    with pytest.raises(ValueError):
        search(index, SearchArgs("on1", "regexp"))


def test_attributes_in_asked_order(index):
    rows = list(results(search(index, SearchArgs("one", attrs=["doc.file"]))))
    assert rows == [{"ngram": ["one", "by", "one"], "count": 7, "args": ["y"]}]
    assert as_results(matching(index, SearchArgs("one"))).first()["args"] == []
    for bad in ("doc.none", "t1", "count"):
        with pytest.raises(ValueError):
            search(index, SearchArgs("one", attrs=[bad]))
    with pytest.raises(ValueError):
        open_index(index.sparkSession, index.inputFiles()[0], ["no.such"])


@pytest.mark.parametrize(("offset", "limit"), [(0, -1), (10, 5), (15, 5), (18, 5), (25, 5), (5, -1), (0, 0)])
def test_paging(spark, offset, limit):
    df = spark.createDataFrame([(f"w{i:02}", 1) for i in range(20)], "t1 string, count long")
    want = [f"w{i:02}" for i in range(20)][offset:]
    got = [r["t1"] for r in search(df, SearchArgs("*", offset=offset, limit=limit)).collect()]
    assert got == (want if limit < 0 else want[:limit])


def test_wrong_arguments():
    for bad in ({"query": ""}, {"query": "a", "query_type": "x"}, {"query": "a", "offset": -1}):
        with pytest.raises(ValueError):
            SearchArgs(**bad)


def test_predicates_reach_the_scan(index):
    plan = lambda args: index.where(predicate(args, 3))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t1,on)" in plan(SearchArgs("on"))
    assert "StringStartsWith(t1,on)" in plan(SearchArgs("on*"))
    assert "StringStartsWith(t1,th)" in plan(SearchArgs("th.*", "regexp"))
    narrow = matching(index, SearchArgs("on"))._jdf.queryExecution().executedPlan().toString()
    assert "doc_file" not in narrow.split("ReadSchema")[1]


def test_export(index, tmp_path):
    assert [r[0] for r in export_lines(index, 2).collect()] == ["on\ta\thill\t2", "on\tthe\tsea\t5", "one\tby\tone\t7"]
    write_export(index, f"{tmp_path}/out", one_file=True)
    assert [r[0] for r in index.sparkSession.read.text(f"{tmp_path}/out").collect()][0] == "On\tthe\tb\t1"
