"""Ranks of the difference cover, and repeats found through them, against plain sorting and comparing."""

from __future__ import annotations

import numpy as np
import pytest

from gridlens.llm import substring_dedup as sd


@pytest.mark.parametrize("length, letters", [(40, 2), (64, 1), (400, 2), (400, 26)])
def test_cover_ranks_are_in_byte_order(length, letters):
    rng = np.random.default_rng(length + letters)
    period, cover = sd.difference_cover(1 if length >= 200 else 0)
    part = rng.integers(97, 97 + letters, 3 * length).astype(np.uint8)
    data = np.concatenate([part, np.zeros(2 * period, np.uint8), part, rng.integers(97, 97 + letters, length).astype(np.uint8), np.zeros(8, np.uint8)])
    sampled = np.flatnonzero(np.isin(np.arange(len(data)) % period, cover % period))
    ranks = sd.cover_ranks(sd._words(data), sampled, period, length)
    depth = period
    while depth < length:
        depth *= 2
    # Beyond the end of the data there are zeros; ranks tell an end that is followed by nothing from more zeros.
    plain = [data[p:p + depth].tobytes() for p in sampled.tolist()]
    inside = [i for i, p in enumerate(sampled.tolist()) if p + depth <= len(data)]
    for i, j in zip(inside[:-1], inside[1:]):
        assert (ranks[i] < ranks[j]) == (plain[i] < plain[j]) and (ranks[i] == ranks[j]) == (plain[i] == plain[j])
    assert [plain[i] for i in sorted(inside, key=lambda i: ranks[i])] == sorted(plain[i] for i in inside)


def _brute(buckets, contents, leads, length):
    starts: dict = {}
    for i, c in enumerate(contents):
        for k in range(len(c) - length + 1):
            starts.setdefault((buckets[i], k - leads[i], c[k:k + length]), []).append((i, k))
    flags = [np.zeros(len(c) - length + 1, bool) for c in contents]
    for found in starts.values():
        for i, k in found if len(found) > 1 else ():
            flags[i][k] = True
    return flags


@pytest.mark.parametrize("length", [32, 40, 199, 200, 400])
def test_repeats_equal_brute_force(length, monkeypatch):
    # No hash decides: the result stays right when all hashes collide.
    monkeypatch.setattr(sd.th, "span_hashes", lambda sums, powers, low, high: np.zeros(len(low), np.uint64))
    rng = np.random.default_rng(length)
    half, repeats = length // 2, 0
    for _ in range(12):
        buckets, contents, leads = [], [], []
        for bucket in range(3):
            whole = rng.integers(97, 99, 2 * (length - half) + half).astype(np.uint8)
            for _ in range(6):
                text = whole.copy()
                if rng.random() < 0.6:
                    text[rng.integers(0, length - half)] ^= 3
                if rng.random() < 0.6:
                    text[rng.integers(length, len(text))] ^= 3
                low = int(rng.integers(0, length - half))
                high = int(rng.integers(low + length, len(text) + 1))
                buckets.append(bucket), contents.append(text[low:high].tobytes()), leads.append(length - half - low)
        found = sd.repeats_in_buckets(np.array(buckets), contents, np.array(leads), length)
        wanted = _brute(buckets, contents, leads, length)
        assert all((f == w).all() for f, w in zip(found, wanted))
        repeats += sum(int(w.sum()) for w in wanted)
    assert repeats > 100
