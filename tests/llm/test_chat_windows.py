"""Chat windows against a plain cutter; conversations of any length are dealt out."""

import re

from newsloom.llm import chat
from newsloom.llm import queries as q

from .test_queries import conversations


def cutter(turns, budget, history):
    """(first new turn, system, history and new places) of each window of one conversation, turns in order."""
    size = lambda t: -(-len(t) // 4) + 4
    tokens = [size(text) for _, text in turns]
    led = turns[0][0] == "system"
    head, upto, at = tokens[0] if led else 0, [], 0
    for n in tokens:
        at += n
        upto.append(at)
    stride, spans, last = max(1, budget - history - head), [], None
    for i in range(int(led), len(turns)):
        cell, alone = (upto[i] - head - 1) // stride, tokens[i] > history
        if alone or last != cell:
            spans.append([i])
        else:
            spans[-1].append(i)
        last = None if alone else cell
    out = []
    for span in spans:
        begin, fresh = upto[span[0]] - tokens[span[0]], sum(tokens[i] for i in span)
        room = max(0, min(history, budget - fresh - head))
        out.append((span[0], [0] if led else [], [i for i in range(int(led), span[0]) if upto[i] - tokens[i] >= begin - room], span))
    return out or [(0, [0], [], [])]


def test_windows_are_those_of_the_cutter(spark):
    budget, history = 256, 64
    rows = [*conversations(), *((70, None, ("user", "assistant")[k % 2], f"{k % 37:02d} {'w' * (k % 90)}") for k in range(400))]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key string, block int, pos int")
    got = {}
    for w in chat.windows(df, budget, history).collect():
        got.setdefault(w["conv_id"], {})[w["window"]] = (w["formatted"], w["n_system"], w["n_history"], w["n_new"])
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    plain = lambda t: t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        want = {}
        for first, led, past, new in cutter(turns, budget, history):
            want[first] = ("".join(f"### {plain(turns[i][0])}\n{plain(turns[i][1])}</turn>\n" for i in [*led, *past, *new]), len(led), len(past), len(new))
        assert got[c] == want, c
    assert set(got) == set(by)


def test_no_stage_is_dealt_by_the_conversation_alone(spark):
    """But for the groups of blocks, one row for 65,536 turns."""
    n = 100_000
    df = spark.range(n).selectExpr("cast(1 as long) conv_id", "id turn", "if(id % 2 = 1, 'assistant', 'user') role", "concat('text ', id) text")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = chat.windows(df)
        plan = w._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"hashpartitioning\(key#\d+L?, null_id#\d+, \d+\)", plan)
    turns, _ = chat.numbered(df, chat.token_estimate)
    assert turns.selectExpr("count(*)", "count(distinct pos)", "max(pos)").first() == (n, n, n - 1)
    assert w.selectExpr("sum(n_new)").first()[0] == n


def test_no_python_in_the_numbering(spark, small):
    turns, _ = chat.numbered(q.read_table(spark, small, "conversations"), chat.token_estimate)
    assert not re.search("Python|Pandas|Arrow", turns._jdf.queryExecution().executedPlan().toString())
