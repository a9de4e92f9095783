import hashlib

from pyspark.sql import functions as F

from stylomill.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, n_turns long, form string"
HARD = "\\### Assistant: </turn> ok"


def turns():
    rows = [
        (-7, 0, "user", HARD), (-7, 1, "assistant", HARD),
        (1, 2, "assistant", "b </turn>\n### user: x"), (1, 0, "system", ""), (1, 1, "user", None), (1, 3, "user", "last \\l \\h \\\\"), (1, 4, "assistant", ""),
        (2, 0, "user", "no answer"), (3, 0, "assistant", "#<\\:"), (3, 1, "odd: role # <", "t"), (4, 0, None, "x"), (4, None, "assistant", "first 🙂"),
        (None, 0, "assistant", "n"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, "assistant", "y" * 40000), (6, 1, "assistant", "z\r\n"),
    ]
    return [(*r, 5, "clash") for r in rows]


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digest(spark):
    df = spark.createDataFrame(turns(), SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in C.chat_digest(C.format_examples(df)).collect()}
    assert got == expected(turns())


def test_each_assistant_turn_is_an_example(spark):
    rows = C.format_examples(spark.createDataFrame(turns(), SCHEMA)).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.n_turns)
    assert [r.n_turns for r in one] == [3, 5]
    assert one[1].text.startswith(one[0].text)
    for r in rows:
        if r.loss_start is not None:
            end = r.loss_start + r.loss_chars
            assert r.text[end:] == C.END and r.text[: r.loss_start].endswith(": ")
    assert sum(r.last for r in rows) == len(expected(turns()))
    assert [r.loss_start for r in rows if r.conv_id == 2] == [None]


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\l", "\\l#<", "###", "</turn>\n", "a\\#b", "\\c:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        assert [r.b for r in df.select(C.unescaped(C.escaped(F.col("t"), role)).alias("b")).collect()] == texts


def test_empty(spark):
    assert C.chat_digest(C.format_examples(spark.createDataFrame([], SCHEMA))).collect() == []


def test_a_conversation_of_very_many_turns(spark):
    """Every assistant turn is an example, the last holds the whole conversation."""
    rows = [(8, k, "assistant" if k % 2 else "user", f"t{k} #", 5, "clash") for k in range(700)] + [(9, 0, "user", "short", 5, "clash")]
    examples = C.format_examples(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: tuple(r)[1:5] for r in C.chat_digest(examples).collect()}
    assert got == expected(rows)
    sizes = {r.n_turns: r.n for r in examples.where("conv_id = 8").select("n_turns", F.char_length("text").alias("n")).collect()}
    assert sorted(sizes) == list(range(2, 701, 2)) and all(sizes[k] < sizes[k + 2] for k in range(2, 700, 2))


def test_no_python_in_the_plan(spark):
    plan = C.chat_digest(C.format_examples(spark.createDataFrame(turns(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
