import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexigram.llm import cgk_decontam as cd
from lexigram.llm.common import text_buffer


def plain(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def slow_distance(item, text):
    """Least edit distance of item to any stretch of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def made(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)] + ["the"] * 60
    items = [" ".join(rng.choices(vocab, k=rng.choice([5, 7, 9, 12, 20, 30, 45]))) + "." for _ in range(25)]
    docs = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if i % 2:
            item = plain(rng.choice(items))
            for _ in range(rng.randint(0, len(item) // 5 + 2)):
                at = rng.randrange(len(item))
                kind = rng.random()
                item[at : at + 1] = [] if kind < 0.3 else ["zz"] if kind < 0.7 else [item[at], "qq"]
                item = item or ["x"]
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append(("&& " if i % 3 else ", ").join(w.title() if i % 5 == 0 else w for w in words))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = made()
    docs += ["", None, "the " * 3000, items[0] * 3, items[3].upper()]
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*items, None, "", "too short"])], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in cd.matches(d, b).collect()}
    want = {}
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            words = plain(item)
            dist = slow_distance(words, plain(t))
            if dist <= len(words) // 5:
                want[i, k] = dist
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    for key, r in got.items():
        assert r["distance"] >= want[key]
        stretch = plain(docs[key[0]])[r["first_word"] : r["end_word"]]
        assert slow_distance(plain(items[key[1]]), stretch) == r["distance"]
    assert sum(r["distance"] == want[k] for k, r in got.items()) >= 0.95 * len(got)
    clean = {r["doc_id"] for r in cd.decontaminate(d, b).collect()}
    assert clean == set(range(len(docs))) - {i for i, _ in got}
    small = {(r["doc_id"], r["item_id"]) for r in cd.matches(d, b, block_words=100).collect()}
    assert small <= set(want) and len(small) >= 0.95 * len(want)


def test_exact_copies_are_never_missed():
    docs, items = made(9)
    words = [cd.word_hashes(*text_buffer(pa.array([t])))[0] for t in items]
    block = cd.Block(list(range(len(items))), words)
    texts = ["x y z " + t + " w" for t in items]
    got = block.matches(*cd.word_hashes(*text_buffer(pa.array(texts))))
    assert {(i, i) for i in range(len(items))} <= {(t, i) for t, i, *_ in got}


def test_embedding_keeps_small_distances_small():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near, far = a.copy(), rng.integers(0, 2**63, 40, dtype=np.uint64)
    near[20] = 5
    keys = [cd.embed(w, np.array([0]), np.array([40]), 40, 64)[0] for w in (a, near, far)]
    assert (keys[0] == keys[1]).sum() > 20 > 3 > (keys[0] == keys[2]).sum()


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert cd.matches(d, b).collect() == [] and cd.decontaminate(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert cd.matches(one, b.limit(0)).collect() == [] and cd.decontaminate(one, b.limit(0)).count() == 1


@pytest.mark.parametrize("m", [5, 9, 60, 120, 200, 300, 600])
def test_items_of_every_size_are_found_after_every_kind_of_edit(m):
    rng = np.random.default_rng(m)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    items = [new(k) for k in [15] * 60 + [m] * 5]
    block = cd.Block(list(range(len(items))), items)
    for kind in range(len(cd.EDITS)):
        want, texts = [], []
        for i in range(60, 65):
            for _ in range(12):
                want.append(i)
                texts.append(np.concatenate([new(30), cd._edited(items[i], kind, rng), new(30)]))
        got = block.matches(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        assert all(k == want[t] and d <= m // 5 for t, k, d, *_ in got)
        assert len({t for t, *_ in got}) >= 0.95 * len(want), cd.EDITS[kind]


def test_common_words_of_many_items_are_met_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    lead = new(4)
    items = [np.r_[lead, new(k)] for k in [3, 8, 12, 30, 60] * 12]
    texts = [np.concatenate([lead] * 30 + [new(5), cd._edited(items[i], 0, rng), new(9)]) for i in range(0, 60, 3)]
    words, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    block = cd.Block(list(range(60)), items)
    want = block.matches(words, at)
    assert len({(t, i) for t, i, *_ in want if i == 3 * t}) >= 19
    monkeypatch.setattr(cd, "MEETINGS", 500)
    assert len(block._rounds(words)) > 10 and block.matches(words, at) == want


def test_short_items_and_unspaced_scripts(spark):
    han = "今天天气很好，我们一起去公园散步。晚上回家吃饭！"
    thai, kana = "วันนี้อากาศดีมาก", "これはテストの文章です。とても短い"
    items = ["What is 2+2?", "yes", "42 is", han, thai, kana, "不", "—?—"]
    docs = [
        "so, WHAT is 2 2, then", "what is 2", "Yes!", "yesterday", "is 42 so 42, is", "前言" + han.replace("公园", "花园") + "abc", "x" + thai + "y", "a" + kana[:3] + "b" + kana,
        "对不起", "今天天气很好", "한국어 문장", "“no”", "", None,
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in cd.matches(d, b).collect()}
    assert got == {(0, 0): 0, (2, 1): 0, (4, 2): 0, (5, 3): 1, (6, 4): 0, (7, 5): 0, (8, 6): 0}
    assert {r["doc_id"] for r in cd.decontaminate(d, b).collect()} == {1, 3, 9, 10, 11, 12, 13}


def test_characters_of_unspaced_scripts_are_words():
    texts = ["ab今日cd、ＡＢ　é€", "中", "文x", "x’y 한글 😀𠀀b", "", "。", "ก1"]
    buf, at = text_buffer(pa.array(texts))
    start, end = cd.bw.plain_spans(buf, at)
    words = [buf[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert words == ["ab", "今", "日", "cd", "ＡＢ", "é€", "中", "文", "x", "x’y", "한글", "😀", "𠀀", "b", "ก", "1"]
    assert np.diff(np.searchsorted(start, at)).tolist() == [6, 1, 2, 5, 0, 0, 2]
