"""What is moved and handed on by the search for repeats, and by all operators that read texts."""

from __future__ import annotations

import random

import brute
import pyarrow as pa
from gridlens.llm import substring_dedup, tables


def test_copies_send_no_bytes(spark, monkeypatch):
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghé ") for _ in range(n))
    copy, passage = noise(2000), noise(600)
    texts = [(i, copy) for i in range(40)] + [(100 + i, noise(500) + passage + noise(500)) for i in range(3)]
    texts += [(200, "x" + passage[:450] + "y"), (201, "z" * 3000), texts[0], texts[41], (None, texts[42][1])]
    written, sort, moved, given = substring_dedup.written, substring_dedup._sorted_buckets, [], []

    def spied(frame):
        moved.extend(c for c, kind in frame.dtypes if kind in ("binary", "string"))
        return written(frame)

    def sorted_spied(classes, length):
        given.extend(classes.collect())
        return sort(classes, length)

    monkeypatch.setattr(substring_dedup, "written", spied)
    monkeypatch.setattr(substring_dedup, "_sorted_buckets", sorted_spied)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = substring_dedup.remove_repeats(frame)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute.repeats(texts, 400), key=key)
    assert not moved
    # Every class once, each with the bytes that its suffixes cover; none of the 40 copies alone.
    assert given and len({(r["bucket"], r["class"]) for r in given}) == len(given)
    assert all(any(bytes(r["content"]) in t.encode() for _, t in texts[40:45]) for r in given)


def test_long_rows_come_in_small_batches(spark, tmp_path):
    spark.createDataFrame([(i, "x" * 20000) for i in range(1500)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(tables.BATCH[0])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    sizes = [r.n for r in tables.table(spark, str(tmp_path), "documents").mapInArrow(run, "n long").collect()]
    assert sum(sizes) >= 30_000_000 and max(sizes) < 6_000_000
