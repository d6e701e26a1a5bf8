from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from gridlens.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, minimum, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from counts of every phrase."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i:i + m]) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= minimum}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and c >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((cut[0], a, " ".join(p), f[p[:cut[1]]], f[p[cut[1]:]]))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def corpus(seed=3, texts=120):
    rnd = random.Random(seed)
    words = ["the", "The", "ÉtÉ", "in", "of", "a", "new", "york", "x\x0by", "b\x00c", "日本", "go"]
    fixed = ["New York City", "the end of the day", "a a a a a a", "one two three four five six", "in the new"]
    rows = []
    for _ in range(texts):
        parts = [rnd.choice(fixed) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        rows.append(("".join(p + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for p in parts), rnd.choice(["en", "en", "de", None, "und"])))
    return [*rows, rows[0], (None, "en"), ("", "fr"), (" \t", None)]


def test_matches_plain_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, 1, 2) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, rank int, f int").repartition(5)
    for settings in ({"minimum": 8}, {"minimum": 3, "top": 15}, {"minimum": 8, "split": 20}):
        found = sorted(tuple(r) for r in phrases.collocations(docs, **settings).collect())
        assert found == plain(rows, settings["minimum"], settings.get("top", 2000))


def test_small_chunks_do_not_cut_routes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 10)
    rows = corpus(5, 60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, minimum=5).collect()) == plain(rows, 5)


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, (4000, 5)).astype(np.uint64)
    words[np.arange(5) >= rng.integers(3, 6, 4000)[:, None]] = 0
    words = words[np.lexsort((words[:, 1], words[:, 0]))]
    n = rng.integers(1, 5, 4000)
    got = {(d, tuple(words[i][:d].tolist())): int(w) for d, first, weight in phrases.sort_suffixes(words, n, np.zeros(4000, bool), 60) for i, w in zip(first, weight)}
    want: Counter = Counter()
    for row, k in zip(words.tolist(), n.tolist()):
        want.update({(d, tuple(row[:d])): k for d in range(2, 6) if row[d - 1]})
    assert got == {p: c for p, c in want.items() if c >= 60}


def test_empty_table_and_very_long_texts(spark, empty):
    assert phrases.collocations(empty).collect() == []
    long = [("home " * 200_000, "en"), (">" * 1_000_000, "en"), (" " * 1_000_000, "en"), ("a b " * 50_000, "de")]
    found = [tuple(r) for r in phrases.collocations(spark.createDataFrame(long, "text string, lang string")).collect()]
    assert sorted(found) == plain(long, 100)
