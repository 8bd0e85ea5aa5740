"""Conversation repair against a plain search over all states and against SQL."""

import random

import duckdb
import pandas as pd
import pytest

from ledgerlens.llm import conversations as C
from ledgerlens.llm.queries import ORACLES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece bigint, audit string, part int"


def slow_repair(rows):
    """Cheapest and then least audit by keeping a whole audit string for every state."""
    def better(states, state, value):
        if state is not None and (state not in states or value < states[state]):
            states[state] = value

    def with_insertions(states):
        for _ in range(4):
            for state, (cost, audit) in list(states.items()):
                better(states, C.after(state, None), (cost + 3, audit + "I"))
        return states

    states = {C.NONE: (0, "")}
    for initial, fate in rows:
        behind = {}
        for state, (cost, audit) in with_insertions(states).items():
            better(behind, state, (cost + 4, audit + "D"))
            if fate != C.DOOMED:
                extra = 3 if fate == C.CUT else 0
                better(behind, C.after(state, initial), (cost + extra, audit + "K"))
                better(behind, C.after(state, None), (cost + extra + 3, audit + "R"))
        states = behind
    ends = with_insertions(states)
    cost, audit = min(v for s, v in ends.items() if s in (C.NONE, C.ASSISTANT))
    return audit, cost


def drawn_rows(seed):
    draw = random.Random(seed)
    initials = [0, 1, 2, 3] if seed % 2 else [0, 1, 1, 2, 2, 3]
    return [(draw.choice(initials), draw.choice([0, 0, 0, 1, 2])) for _ in range(draw.randrange(1, 40))]


@pytest.mark.parametrize("first", range(0, 600, 100))
def test_audits_match_a_plain_search(first):
    for seed in range(first, first + 100):
        rows = drawn_rows(seed)
        codes = [initial + 4 * fate for initial, fate in rows]
        assert C.edits(codes, C.NONE, C.ENDS, last=True) == slow_repair(rows)


def test_ends_stay_close():
    """What BEHIND rests on: the best ends from any two states differ by 10 at most."""
    for seed in range(300):
        codes = [initial + 4 * fate for initial, fate in drawn_rows(seed)]
        ends, _ = C.of_rows().behind(codes, C.ENDS)
        assert max(ends) <= 10


def turns(seed):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \n", "", None, "Done! ", "tail \t", "Öl und Maß.", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(draw.choice([1, 2, 5, 9])):
            turn = draw.choice([turn, turn, turn, turn * 3, None, turn - 4])
            row = (conv, turn, draw.choice(roles), draw.choice(texts))
            rows += [row] * draw.choice([1, 1, 1, 2])
    rows.append((77, 5, "user", "long. " * 200_000 + "end"))
    return rows


@pytest.mark.parametrize("piece", [2, 3, C.PIECE])
def test_report_and_hashes_match_sql(spark, piece):
    rows = turns(piece)
    frame = spark.createDataFrame([(*r, 3, "DDD", 0) for r in rows], SCHEMA)
    found = C.repair_damaged(frame, piece).toPandas()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("given", conversations)
    con.execute("CREATE TABLE conversations AS SELECT * FROM given")
    slow = con.execute(ORACLES["op11_conversation_repair"])
    columns = [d[0] for d in slow.description]
    expected = {r[0]: r for r in slow.fetchall()}
    assert len(found) == len(expected) == 42
    for row in found[columns].itertuples(index=False):
        key = None if pd.isna(row[0]) else row[0]
        assert tuple(row)[1:] == expected[key][1:]


def test_repaired_rows_follow_the_roles(spark):
    frame = spark.createDataFrame([(*r, 3, "DDD", 0) for r in turns(11)], SCHEMA)
    rows = C.repair(frame, 4).rows.collect()
    by_conv = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for repaired in by_conv.values():
        assert [r.place for r in repaired] == list(range(1, len(repaired) + 1))
        initials = "".join(r.role[0] for r in repaired)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert all(r.text == "" for r in repaired if r.edit == "I")


def test_table_without_rows(spark):
    assert C.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
