import hashlib
import random

from terrasift.llm import chat


def expected(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(3)
    pieces = ["word ", "### user: ", "</turn>\n", "\\", "\\### Assistant: </turn> ok", "é漢 ", "\n", "#", ":", "<"]
    rows, want = [], {}
    for conv in [None, *range(40)]:
        turns = [(rng.choice(["system", "user"]) if i == 0 else rng.choice(["user", "assistant", "od:d"]), "".join(rng.choices(pieces, k=rng.randrange(120)))) for i in range(rng.randrange(1, 30))]
        want[conv] = expected(turns)
        rows += [(conv, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, 80, 20)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == want
    for r in windows.collect():  # budgets hold unless a single new turn is over them
        turns = chat.parse(r["text"])
        assert sum(len(t.split()) + chat.OVERHEAD for _, t in turns) <= 80 or len(turns) - r["repeated"] == 1
        assert r["window"] == 0 or r["repeated"] < len(turns)


def test_system_turn_heads_every_window():
    w = chat.Windows(20, 0)
    closed = [c for t in [("system", "s"), *[("user", "a b c d e f")] * 4] if (c := w.add(*t))] + [w.close()]
    assert len(closed) > 1 and all(chat.parse(c[1])[0] == ("system", "s") for c in closed)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_windows(df)).collect()
    assert [tuple(x)[1:5] for x in r] == [expected([("", ""), ("", "")])]
    assert chat.format_windows(df.limit(0)).collect() == []


def test_ties_on_a_turn_and_very_long_conversations(spark):
    """Equal turn numbers go by role, then text; a turn far over the budget keeps its whole text."""
    long = "word " * 50_000
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, 1, "assistant", long), (2, None, "user", "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got == {1: expected([("assistant", "z"), ("user", "a"), ("user", "b"), ("assistant", long)]), 2: expected([("user", "x"), ("assistant", "y"), ("assistant", "y")])}
