"""Small intermediate tables are written in few files, however many partitions a shuffle has."""

from __future__ import annotations

import pytest
from gridlens.llm import components, minhash


@pytest.fixture
def many_partitions(spark):
    """As many partitions as a shuffle has, none put together."""
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def counted(monkeypatch, module) -> list[int]:
    parts, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda frame: (made := stored(frame), parts.append(made.rdd.getNumPartitions()))[0])
    return parts


def test_components(spark, monkeypatch, many_partitions):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    parts = counted(monkeypatch, components)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(31)} | {(i, 90) for i in (90, 95, 100)}
    assert parts and max(parts) == 1
    none = components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert none.columns == ["node", "root"] and not none.collect()


def test_near_duplicates(spark, monkeypatch, many_partitions):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[:40 + i])) for i in range(8)] + [(20, "a b c d e"), (21, None), (22, " ".join(words[:40]))]
    parts = counted(monkeypatch, minhash)
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {**dict.fromkeys([*range(8), 22], 0), 20: 20, 21: 21}
    assert sorted(parts)[len(parts) // 2] == 1
