import random

from lexigram.llm import chat_format as cf


def slow(rows):
    """Formats turns (role, text) one by one."""
    out, spans, last = "", [], None
    for role, text in rows:
        role, text = role or "", text or ""
        esc = ""
        for i, ch in enumerate(text):
            j = i - 1
            while j >= 0 and text[j] == "\\":
                j -= 1
            esc += ("\\" if ch == "|" and j >= 0 and text[j] == "<" else "") + ch
        out += "<|turn_sep|>" if role == last else ("<|im_end|>\n" if last is not None else "") + f"<|im_start|>{role}\n"
        if role == "assistant":
            spans.append((len(out), len(out) + len(esc)))
        out, last = out + esc, role
    return out + "<|im_end|>\n", spans


def test_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_end|>", "<|turn_sep|>", "<", "|", "\\", ">", "\n", "é", "<\\|", "assistant", "", "\U0001f600"]
    convs = {0: [("user", None), ("user", "<"), ("assistant", "|im_end|>"), ("assistant", ""), ("system", "x")], 1: [("assistant", "a")], 2: [("user", "only")]}
    for c in range(3, 60):
        convs[c] = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 7))]
    rows = [(c, i, r, t, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages string")
    made = cf.format_conversations(df)
    got = {r["conv_id"]: r for r in made.collect()}
    back = {r["conv_id"]: r for r in cf.read_back(made).collect()}
    for c, turns in convs.items():
        text, spans = slow(turns)
        assert got[c]["formatted"] == text
        assert [tuple(s) for s in got[c]["loss_spans"]] == spans
        assert [tuple(t) for t in back[c]["turns"]] == [(r, t or "") for r, t in turns]
        assert back[c]["loss_text"] == "".join(t or "" for r, t in turns if r == "assistant")


def test_odd_roles_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, None, "a\nb\\n<|x|>", "t"), (None, 1, None, None), (None, 1, "z", "b"), (None, 1, "z", "a")], "conv_id long, turn long, role string, text string")
    (r,) = cf.read_back(cf.format_conversations(df)).collect()
    assert [tuple(t) for t in r["turns"]] == [("a\nb\\n<|x|>", "t"), ("", ""), ("z", "a"), ("z", "b")]


def test_empty_table(spark):
    assert cf.read_back(cf.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_spans_of_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", "é" * (i % 7) + "<|x|>" * (i % 2)) for i in range(2000)] + [(2, i, "assistant", "ab") for i in range(256)] + [(3, 0, "user", "")]
    made = cf.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in made.collect()}
    assert {k: len(r["loss_spans"]) for k, r in got.items()} == {1: sum(i % 3 > 0 for i in range(2000)), 2: 256, 3: 0}
    unescape = lambda t: t.replace("<\\|", "<|")
    assert [unescape(got[1]["formatted"][s["start"] : s["end"]]) for s in got[1]["loss_spans"]] == [r[3] for r in rows[:2000] if r[2] == "assistant"]
