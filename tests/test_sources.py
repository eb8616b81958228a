import bz2
import gzip
import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexigram import build, cli, server
from lexigram.config import BuildConf, SearchConf, corpus_name
from lexigram.functions.text import check_charset
from lexigram.operators.rules import cnf
from lexigram.operators.store import open_index
from lexigram.sources import readers
from lexigram.streaming.counts import stream_counts

VERTICAL = """x\tX
<doc file="a" n="1">
<s>
The\tD
dog\tN
<g/>
.\tZ
</s>
<s>
the\tD
,\tZ
Dog\tN
barks\tV
</s>
</doc>
y\tY
<doc n="2">
<s>
the\tD
dog\tN
</s>
</doc>
"""


@pytest.fixture
def vert(tmp_path):
    (tmp_path / "corp.vert").write_text(VERTICAL)
    return str(tmp_path / "corp.vert")


def test_vertical_tokens_and_attributes(spark, vert):
    rows = readers.vertical(spark, vert, ["doc.file", "doc.n"], tag_column=1).where("tok is not null").orderBy("pos").collect()
    assert [(r["tok"], r["tag"], r["doc_file"], r["doc_n"]) for r in rows] == [
        ("x", "X", None, None), ("the", "D", "a", "1"), ("dog", "N", "a", "1"), (".", "Z", "a", "1"), ("the", "D", "a", "1"), (",", "Z", "a", "1"),
        ("dog", "N", "a", "1"), ("barks", "V", "a", "1"), ("y", "Y", None, None), ("the", "D", None, "2"), ("dog", "N", None, "2"),
    ]


def test_vertical_in_many_pieces(spark, tmp_path):
    lines = []
    for d in range(40):
        lines += [f'<doc file="f{d}">', *[f"w{(d * 7 + i) % 23}" for i in range(25)], "</doc>", "between"]
    (tmp_path / "v").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = readers.vertical(spark, str(tmp_path / "v"), ["doc.file"]).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, file = [], None
    for line in lines:
        if line.startswith("<"):
            file = None if line.startswith("</") else line.split('"')[1]
        want.append((None if line.startswith("<") else line, file))
    assert [r["pos"] for r in got] == list(range(len(lines)))
    assert [(r["tok"], r["doc_file"]) for r in got] == want


def test_vertical_options(spark, vert, tmp_path):
    assert readers.vertical(spark, vert, breaks=False).where("tok is null").count() == 0
    toks = [r["tok"] for r in readers.vertical(spark, vert, ignore_structs=["doc"], ignore=["x"]).where("tok is not null").orderBy("pos").collect()]
    assert toks == ["y"]
    readers.vertical(spark, vert, strict=True)
    (tmp_path / "bad").write_text("<s>\na\n</s>\n</s>\n")
    with pytest.raises(ValueError):
        readers.vertical(spark, str(tmp_path / "bad"), strict=True)
    with pytest.raises(ValueError):
        readers.vertical(spark, vert, ["nodot"])


TEXT = "Lorem ipsum, dolor\nsit amet. Žluťoučký kůň\n"


@pytest.mark.parametrize("kind", ["plain", "gz", "bz2", "windows-1250"])
def test_plain_sources(spark, tmp_path, kind):
    path = tmp_path / {"gz": "c.txt.gz", "bz2": "c.txt.bz2"}.get(kind, "c.txt")
    raw = TEXT.encode("windows-1250" if kind == "windows-1250" else "utf-8")
    path.write_bytes({"gz": gzip.compress, "bz2": bz2.compress}.get(kind, bytes)(raw))
    got = readers.plain(spark, str(path), "windows-1250" if kind == "windows-1250" else "utf-8").orderBy("pos").collect()
    assert [r["tok"] for r in got] == ["lorem", "ipsum", "dolor", "sit", "amet", "žluťoučký", "kůň"]


@pytest.mark.parametrize("charset", ["iso-8859-1", "windows-1250", "utf-16"])
@pytest.mark.parametrize("kind", ["gz", "bz2", "txt"])
def test_compressed_sources_in_other_charsets(spark, tmp_path, charset, kind):
    pack = {"gz": gzip.compress, "bz2": bz2.compress, "txt": bytes}[kind]
    words = [["straße", "über"], ["\xf6l", "más"]] if charset == "iso-8859-1" else [["žluťoučký", "kůň"], ["öl", "řeka"]]
    for i, (a, b) in enumerate(words):
        (tmp_path / f"c{i}.{kind}").write_bytes(pack(f"{a} x,\r\n{b}\n".encode(charset)))
        (tmp_path / f"v{i}.{kind}").write_bytes(pack(f'<doc file="{a}">\n{a}\tN\n{b}\tN\n</doc>\n'.encode(charset)))
    (tmp_path / f"c2.{kind}").write_bytes(pack(b""))
    rows = readers.plain(spark, f"{tmp_path}/c*", charset).orderBy("file", "pos").collect()
    assert [r["tok"] for r in rows] == [t for a, b in words for t in (a, "x", b)] and len({r["file"] for r in rows}) == 2
    rows = readers.vertical(spark, f"{tmp_path}/v*", ["doc.file"], charset, tag_column=1, breaks=False).orderBy("file", "pos").collect()
    assert [(r["tok"], r["tag"], r["doc_file"]) for r in rows] == [(t, "N", a) for a, b in words for t in (a, b)]


def test_charsets():
    assert check_charset("") == "utf-8"
    with pytest.raises(ValueError):
        check_charset("foo")


def test_large_files_are_numbered_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PIECE_LINES", 7)
    lines = [f"w{i} x" if i % 9 else f'<doc file="f{i}">' for i in range(200)]
    for kind, charset in (("gz", "utf-8"), ("gz", "windows-1250"), ("txt", "utf-16")):
        raw = "\n".join(lines).encode(charset)
        (tmp_path / f"v.{kind}").write_bytes(gzip.compress(raw) if kind == "gz" else raw)
        got = readers.vertical(spark, f"{tmp_path}/v.{kind}", ["doc.file"], charset).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(200))
        assert [(r["tok"], r["doc_file"]) for r in got] == [(f"w{i} x" if i % 9 else None, f"f{i - i % 9}") for i in range(200)]


@pytest.mark.parametrize(
    ("text", "right"),
    [("<a>\n<b>\nx\n</b>\n<c/>\n</a>\n<b>\n</b>", True), ("<a>\n<b>\n</a>\n</b>\n<c>\n</c>", False), ("<a>\nx", False), ("</a>\nx", False), ("<a>\n</a>\n</a>\n<a>", False), ("<a>\n<a>\n</a>\n</a>\nx", True), ("<a>\n</b>\n<b>\n</a>", False), ("x\ny", True)],
)
@pytest.mark.parametrize("piece", [1, 2, 1000])
def test_strict_structures(spark, tmp_path, monkeypatch, text, right, piece):
    monkeypatch.setattr(readers, "PIECE_LINES", piece)
    (tmp_path / "v").write_text(text + "\n")
    if right:
        readers.vertical(spark, f"{tmp_path}/v", strict=True)
    else:
        with pytest.raises(ValueError):
            readers.vertical(spark, f"{tmp_path}/v", strict=True)


def test_attribute_ids_follow_the_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0").write_text('x\ny\nz\n<doc file="first">\nw\n</doc>\n')
    (tmp_path / "c" / "1").write_text('<doc file="second">\nw\n</doc>\n')
    where = build.build_index(spark, BuildConf.of(conf_of(f"{tmp_path}/c")), 1)
    got = {r["value"]: r["id"] for r in spark.read.parquet(f"{where}/attr_doc_file").collect()}
    assert got == {None: 0, "first": 1, "second": 2}


def test_filter_modules(spark, vert, tmp_path):
    (tmp_path / "mine.py").write_text("def verbs(words, tags):\n    return tags[-1] == 'V'\n\n\ndef long(words, tags):\n    return len(words[-1]) > LEAST\n\n\nlong.plain = True\nLEAST = 4\n")
    for fn in ("verbs", "long"):
        rows = build.ngrams(spark, BuildConf.of(conf_of(vert, ngramFilter={"lib": f"{tmp_path}/mine.py", "fn": fn}, tagAttrIdx=1)), 2).collect()
        assert [(r["t1"], r["t2"]) for r in rows] == [("dog", "barks")]
    for bad in ({"lib": "nowhere.py", "fn": "x"}, {"lib": f"{tmp_path}/mine.py", "fn": "none"}):
        with pytest.raises(ValueError):
            build.ngrams(spark, BuildConf.of(conf_of(vert, ngramFilter=bad)), 2)


def test_plain_windows_run_across_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text(TEXT)
    rows = build.ngrams(spark, BuildConf(str(tmp_path / "c.txt"), "plain", ignore=["sit"]), 2).collect()
    assert ("dolor", "amet") in {(r["t1"], r["t2"]) for r in rows} and len(rows) == 5


def conf_of(vert, **more):
    return {"inputFilePath": vert, "sourceType": "vertical", "args": {"doc.file": "col8"}, "ngramStopStrings": ["."], "ngramIgnoreStrings": [","], "tmpDir": "/x", "procChunkSize": 5, **more}


def test_build_search_export_and_cli(spark, vert, tmp_path, capsys):
    conf = BuildConf.of(conf_of(vert))
    where = build.build_index(spark, conf, 2)
    rows = {(r["t1"], r["t2"]): (r["count"], r["doc_file"]) for r in open_index(spark, f"{where}/ngrams").collect()}
    assert rows == {("the", "dog"): (3, "a"), ("dog", "barks"): (1, "a")}
    assert [r["word"] for r in spark.read.parquet(f"{where}/words").orderBy("id").collect()] == ["barks", "dog", "the", "x", "y"]
    values = {r["value"]: r["id"] for r in spark.read.parquet(f"{where}/attr_doc_file").collect()}
    assert values == {None: 0, "a": 1}
    out = build.extract_ngrams(spark, BuildConf.of(conf_of(vert, minNgramFreq=2)), 2)
    assert out.endswith("corp_2-grams.txt") and [r[0] for r in spark.read.text(out).collect()] == ["the\tdog\t3"]
    (tmp_path / "build.json").write_text(json.dumps(conf_of(vert)))
    (tmp_path / "search.json").write_text(json.dumps({"dataPath": str(tmp_path)}))
    assert cli.main(["-ngram-size", "3", "create-index", str(tmp_path / "build.json")], spark) == 0
    assert cli.main(["-conf-path", str(tmp_path / "search.json"), "-attrs", "doc.file", "search", "corp", "th*"], spark) == 0
    assert "res[0]: the dog barks (1, ['a'])" in capsys.readouterr().out
    assert cli.main(["help"], spark) == 0


def test_filter_rules(spark, vert):
    rules = [[{"attr": "doc.n", "value": "2"}, {"attr": "doc.n", "value": "9"}]]
    rows = build.ngrams(spark, BuildConf.of(conf_of(vert, filterArgs=rules)), 2).collect()
    assert [(r["t1"], r["t2"], r["count"]) for r in rows] == [("the", "dog", 1)]
    df = spark.createDataFrame([("a",), (None,), ("b",)], "doc_n string")
    assert df.where(cnf([[{"attr": "doc.n", "op": "!=", "value": "a"}]])).count() == 2
    for bad in ([[]], [[{"attr": "x", "op": "<", "value": "1"}]]):
        with pytest.raises(ValueError):
            cnf(bad)


def test_prefix_setting_and_window_filter(spark, vert):
    from lexigram.functions import filters

    assert [r["t1"] for r in build.ngrams(spark, BuildConf.of(conf_of(vert, ngramMatchPrefix=["d"])), 2).collect()] == ["dog"]
    filters.register("verb_last", lambda words, tags: tags[-1] == "V")
    rows = build.ngrams(spark, BuildConf.of(conf_of(vert, ngramFilter={"fn": "verb_last"}, tagAttrIdx=1)), 2).collect()
    assert [(r["t1"], r["t2"]) for r in rows] == [("dog", "barks")]


def test_settings():
    assert corpus_name("/a/b/corp.vert.gz") == "corp.vert"
    assert BuildConf.of({"inputFilePath": "/d/x.txt", "sourceType": "plain"}).out_dir == "/d"
    for bad in ({"inputFilePath": "x", "sourceType": "no"}, {"sourceType": "plain"}, {"inputFilePath": "x", "sourceType": "plain", "typo": 1}, {"inputFilePath": "x", "sourceType": "plain", "args": {"a": "col9"}}):
        with pytest.raises(ValueError):
            BuildConf.of(bad)


def test_http(spark, vert, tmp_path):
    build.build_index(spark, BuildConf.of(conf_of(vert)), 2)
    conf = SearchConf(str(tmp_path))
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), server.handler(spark, conf))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{httpd.server_port}{path}") as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert get("/")[1]["name"] == "lexigram"
        status, body = get("/search?corpus=corp&q=the&attrs=doc.file&limit=5")
        assert status == 200 and body["size"] == 1 and body["rows"] == [{"ngram": ["the", "dog"], "count": 3, "args": ["a"]}]
        assert get("/search?corpus=corp&q=d.*&qtype=regexp")[1]["size"] == 1
        assert get("/nothing")[0] == 404 and get("/search?corpus=none&q=a")[0] == 404
        for bad in ("/search?q=a", "/search?corpus=corp", "/search?corpus=corp&q=a&limit=x", "/search?corpus=corp&q=a&qtype=z", "/search?corpus=corp&q=1&qtype=regexp", "/search?corpus=corp&q=a%20(b&qtype=regexp", "/search?corpus=..&q=a", "/search?corpus=corp&q=the&attrs=no.no"):
            assert get(bad)[0] == 400, bad
    finally:
        httpd.shutdown()


def test_streaming_counts(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a b a b"), (2, "b a")], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    q = stream_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    q.processAllAvailable()
    spark.createDataFrame([(3, "a b")], "doc_id long, text string").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {(r["t1"], r["t2"]): r["count"] for r in spark.sql("select * from grams").collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 2}
    assert F is not None


def test_only_small_tables_are_spread(spark, monkeypatch):
    small = spark.range(50).coalesce(1)
    assert readers.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(readers, "SPREAD_BYTES", 10)
    assert readers.spread(small).rdd.getNumPartitions() == 1
