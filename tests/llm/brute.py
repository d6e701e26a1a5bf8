"""Plain computations that the operators of the subpackage are held against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WHITE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """(key, n_shingles, component_id) per row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = {(a, b) for h in holders.values() for j, b in enumerate(h) for a in h[:j]}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    best: dict[int, object] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            root = find(i)
            best[root] = key if best.get(root) is None else min(best[root], key)
    return [(key, len(sets[i]), best.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row, from every string of the length."""
    data = [(t or "").encode() for _, t in rows]
    starts = defaultdict(int)
    for d in data:
        for i in range(len(d) - length + 1):
            starts[d[i:i + length]] += 1
    out = []
    for (key, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), bytes(gone)))
        out.append((key, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows: list[tuple], items: list[tuple], span: int = 10) -> list[tuple]:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) per row, from all windows."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORD.findall((text or "").translate(LOWER))
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i:i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        words = ALNUM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if owner := windows.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= owner
        names = ",".join(sorted(str(f) for f in found if f is not None))
        out.append((key, len(words), len(hit), len({f for f in found if f is not None}),
                    hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def base_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WHITE_WORD.findall(text)
    lines = [x for x in text.split("\n") if WHITE_WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    repeated = {p + j for at in places.values() if len(at) > 1 for p in at for j in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def components_by_row(rows: list[tuple], percent: int = 80) -> list[int]:
    """A component name per row: the place of its first row."""
    named = components([(i, t) for i, (_, t) in enumerate(rows)], percent)
    return [c for _, _, c in named]


def removed(rows: list[tuple], length: int) -> list[tuple]:
    """Rows without bytes that repeated strings cover; characters that are cut in two are dropped."""
    starts = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            starts[d[i:i + length]] += 1
    out = []
    for (key, text), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((key, bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore") if any(gone) else text))
    return out
