"""The pipeline against plain computations, stage after stage, and the entry point without the subpackage."""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import sys
from pathlib import Path

import brute
import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DOCS
from gridlens.llm import bpe, queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    """documents, labels and benchmark; toxic texts say moron twice, two texts hold a benchmark item."""
    root = tmp_path_factory.mktemp("corpus")
    prose = [t for _, t in texts if t and len(t.split()) > 80]
    item = "these are the ten words that nobody may train on at all"
    rows = [(1000 + i, f"{p[:400]} moron {i}. what a moron") for i, p in enumerate(prose[:8])]
    rows += [(2000, "Before. " + item + ". After it."), (2001, " ".join(prose[3].split()[:30]) + " " + item.upper())]
    rows += [(3000 + i, f"quite ordinary words {i} about nothing in particular, number {i * i}") for i in range(30)]
    rows = [*texts, *rows]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(k, 1, int("moron" in (t or ""))) for k, t in rows if k is not None and k >= 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows


def test_pipeline_against_brute_force(spark, folder):
    root, rows = folder
    rows = [r for r in rows if "moron" not in (r[1] or "")]
    parts = brute.components_by_row(rows)
    kept, seen = [], set()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        name = parts[i] if brute.shingles(rows[i][1]) else ("empty", rows[i][0])
        if name not in seen:
            seen.add(name)
            kept.append(rows[i])
    left = brute.removed(kept, 400)
    items = [tuple(r.values()) for r in pq.read_table(f"{root}/benchmark.parquet").to_pylist()]
    clean = [r for r, c in zip(left, brute.contamination(left, items)) if not c[-1]]
    codec = bpe.Codec(bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), bpe.public_tokenizers.PATTERN)
    expected = sorted((str(k), hashlib.sha256((t or "").encode()).hexdigest(),
                       hashlib.sha256(codec.encode(t or "")).hexdigest()) for k, t in clean)
    found = corpus_pipeline.run(spark, root).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256, r.ids_sha256) for r in found) == expected
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in found)


def test_stages_keep_the_columns(spark, folder, empty):
    root, _ = folder
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, root).columns == empty.columns, name


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_entry_point_without_the_subpackage(tmp_path):
    """Everything but both llm folders is there, with and without the pipeline's file."""
    shutil.copytree(ROOT, tmp_path / "with", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git"))
    shutil.copytree(ROOT, tmp_path / "without", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    for place in (tmp_path / "with", tmp_path / "without"):
        done = subprocess.run([sys.executable, "-c", code], cwd=place, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(place)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
