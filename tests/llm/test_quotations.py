"""Quotation linking on a hand-made chat."""

from __future__ import annotations

import pytest
from gridlens.llm import quotations

CHAT = [
    (1, 0, "user", "Shall we meet on Monday?\nOr on Tuesday at noon?\n\nBring the red folder."),
    (1, 1, "assistant", "Monday suits me."),
    (1, 2, "user", "On Monday, somebody wrote:\n> Or on  tuesday at noon?\nRather this one."),
    (1, 3, "assistant", "> Monday suits me.\nAnd me.\n> nobody said this"),
    (1, 4, "user", ">> Or on Tuesday at noon?\n> Rather this one.\nAgreed then."),
    (1, 5, "assistant", "> Bring the red folder.\nWill do."),
    (2, 0, "user", "> Monday suits me\n>   \nWhat about us?"),
    (2, 1, "assistant", None), (2, 2, "user", ""), (2, 3, "user", "> > >"), (2, 3, "user", "> > >"),
    (3, None, "system", "a > b\n  x"), (None, 7, "user", "loose"), (None, 8, None, "> loose"),
]
SCHEMA = "conv_id long, turn long, role string, text string, position string, pos int, level int"


@pytest.fixture(scope="module")
def linked(spark):
    frame = spark.createDataFrame([(*m, "x", 1, 2) for m in CHAT], SCHEMA).repartition(4)
    return quotations.link_quotations(frame).collect()


def test_links(linked):
    by = {(r.conv_id, r.turn): r for r in linked}
    assert len(linked) == len(CHAT)
    assert by[1, 2].body == "Rather this one." and by[1, 2].reply_to == 0 and by[1, 2].n_quotes == by[1, 2].n_linked == 1
    assert by[1, 3].body == "And me." and (by[1, 3].n_quotes, by[1, 3].n_linked, by[1, 3].reply_to) == (2, 1, 1)
    assert [(q.level, q.source_turn) for q in by[1, 4].quotes] == [(2, 0), (1, 2)] and by[1, 4].reply_to == 2
    assert by[1, 5].reply_to == 0 and by[1, 1].reply_to == 0 and by[1, 0].reply_to is None
    q = by[2, 0].quotes[0]
    assert (q.source_conversation, q.source_turn, by[2, 0].reply_to, by[2, 0].body) == (1, 1, None, "What about us?")
    assert by[2, 1].body == "" and by[2, 3].n_quotes == 0 and by[3, None].body == "a > b\n  x"
    assert by[None, 8].n_linked == 1 and by[None, 8].reply_to == 7


def test_reply_order(linked):
    order = [r.turn for r in sorted((r for r in linked if r.conv_id == 1), key=lambda r: r.position)]
    # 3 continues the branch of 0 and 1; 2 starts one that 4 continues; 5 starts the last.
    assert order == [0, 1, 3, 2, 4, 5]
    for c in (1, 2, 3, None):
        own = [r for r in linked if r.conv_id == c]
        assert sorted(r.position for r in own) == list(range(1, len(own) + 1))
        place = {r.turn: r.position for r in own}
        assert all(r.reply_to is None or place[r.reply_to] <= r.position for r in own)


def test_native_and_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    found = quotations.link_quotations(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0 and "Python" not in plan and "Arrow" not in plan
