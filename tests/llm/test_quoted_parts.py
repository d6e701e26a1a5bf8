"""Sources of every part of a quotation, against a linker that compares all messages."""

from __future__ import annotations

import random
import re

import pytest
from gridlens.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = "red folder noon monday tuesday agreed perhaps later".split()


def words(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" >.,:[]")


def split(text):
    """Body and runs of quoted lines (level, text)."""
    runs, own, last = [], [], None
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]?>)*", line)[0]
        level, rest = marks.count(">"), re.sub("^ ", "", line[len(marks):]) if marks else line
        if not level:
            own.append(line)
        elif level == last:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in runs]


def brute(messages):
    """Per (conversation, turn): list of (level, best source, sources) of its passages."""
    said = []
    for conv, turn, _, text in messages:
        own = split(text)[0]
        said.append({words(p) for p in (own, *re.split(r"\n\s*\n", own), *own.split("\n"))} - {""})
    out = {}
    for i, (conv, turn, _, text) in enumerate(messages):
        out[conv, turn] = []
        for level, run in split(text)[1]:
            for passage in re.split(r"\n\s*\n", run):
                if not words(passage):
                    continue
                lines = [words(x) for x in passage.split("\n") if words(x)]
                parts = [(-1, words(run)), (0, words(passage)), *enumerate(lines, 1)]
                parts = [(way, p) for way, p in parts if way == 0 or p != words(passage)]
                found = []
                for way, part in parts:
                    near = [j for j in range(i) if part in said[j] and messages[j][0] == conv]
                    far = [j for j in range(len(messages)) if part in said[j] and messages[j][0] != conv]
                    if near or far:
                        found.append((not near, way, messages[(near or far)[0]][:2]))
                out[conv, turn].append((level, sorted(found)[0][2] if found else None, [f[1:] for f in sorted(found)]))
    return out


def linked(spark, messages):
    rows = quotations.link_quotations(spark.createDataFrame(messages, SCHEMA).repartition(4)).collect()
    return {(r.conv_id, r.turn): r for r in rows}


def seen(row):
    return [(q.level, q.source_turn if q.source_turn is None else (q.source_conversation, q.source_turn),
             [(s.part, (s.conversation, s.turn)) for s in q.sources]) for q in row.quotes]


CHAT = [
    (1, 0, "user", "First thing.\nIt has two lines."), (1, 1, "assistant", "Second thing."),
    (1, 2, "user", "One para\nof two lines.\n\nAnother para\nwith more.\n\nA third."),
    (1, 3, "user", "> First thing.\n> It has two lines.\n>\n> Second thing.\nBoth."),
    (1, 4, "user", "> [...] has\n> Second thing.\nTrimmed at first."),
    (1, 5, "user", "> One para of\n> two lines.\n> \n> Another para with\n> more.\nNew breaks."),
]


def test_every_part_is_linked(spark):
    by = linked(spark, CHAT)
    assert [q.source_turn for q in by[1, 3].quotes] == [0, 1] and by[1, 3].reply_to == 0
    assert by[1, 4].n_linked == 1 and by[1, 4].reply_to == 1
    assert [q.source_turn for q in by[1, 5].quotes] == [2, 2] and by[1, 5].reply_to == 2
    assert {k: seen(r) for k, r in by.items()} == brute(CHAT)


def test_ids_of_conversations_are_no_time(spark):
    chat = [(1, 0, "user", "> It rains here.\nIndeed."), (1, 1, "user", "It rains here."), (2, 0, "user", "It rains here."),
            (3, 0, "user", "> Only mine\nNo."), (3, 1, "user", "Only mine"), (None, 0, "user", "> It rains here.")]
    by = linked(spark, chat)
    # Its own conversation says it later only, another one at any time.
    assert seen(by[1, 0])[0][1] == (2, 0) and by[1, 0].reply_to is None
    assert by[3, 0].n_linked == 0 and seen(by[None, 0])[0][1] == (1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_chats(spark, seed):
    rnd = random.Random(seed)
    messages = []
    for conv in range(4):
        for turn in range(10):
            line = lambda: " ".join(rnd.choices(WORDS, k=rnd.randint(1, 2)))
            out = [f"{line()}{conv if rnd.random() < .5 else ''}" for _ in range(rnd.randint(1, 3))]
            if messages and rnd.random() < .7:
                quoted = split(rnd.choice(messages)[3])[0].split("\n") + rnd.choice([[], ["", line()]])
                if rnd.random() < .4:
                    quoted[0] = "[...]"
                out = [f"{rnd.choice(['>', '> >'])} {quoted[0]}", *[f"> {q}" for q in quoted[1:]], *out]
            else:
                out.insert(rnd.randint(0, 1), "")
            messages.append((conv, turn, "user", "\n".join(out)))
    assert {k: seen(r) for k, r in linked(spark, messages).items()} == brute(messages)
