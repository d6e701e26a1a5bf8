from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_texts(seed: int = 7) -> list[tuple]:
    """(id, text) with missing and empty values, copies, near copies, shared passages, ties and a very long text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 6)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    base = [prose(rnd.randint(40, 160)) for _ in range(12)]
    passage, line = prose(90), prose(12)
    texts: list[str | None] = [None, "", " \n\t", "one", "One two", "one two three four", "x" * 3000, *base]
    for b in base[:6]:
        words = b.split(" ")
        for _ in range(4):
            edited = list(words)
            for i in rnd.sample(range(len(words)), rnd.randint(0, 3)):
                edited[i] = word()
            texts.append(" ".join(edited))
    texts += [base[0], base[0], base[1].upper(), prose(20) + passage + prose(15), passage + prose(30), prose(5) + passage]
    texts += [f"{line}\n{prose(4)}\n{line}\n{line}" for _ in range(5)]
    texts += [prose(3000) + passage + prose(2000), "ab " * 400, "漢字かな交じり文、" * 60, "a\x00b\x1f c\u0085d 　e"]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, base[2]), (None, None), (500, base[3])]


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The rows as a table with further columns, two of them named like results."""
    rows = [(k, t, "en", "s", len(t or ""), 1.0, "x") for k, t in texts]
    return spark.createDataFrame(rows, DOCS + ", score double, component_id string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
