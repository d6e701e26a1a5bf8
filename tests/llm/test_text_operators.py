"""Joins, deduplication, decontamination and encoding against plain computations."""

from __future__ import annotations

import base64
import hashlib

import brute
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from gridlens.llm import bpe, decontaminate, ngram_join, substring_dedup

ANY = lambda row: tuple((v is None, str(v)) for v in row)


def rows_of(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=ANY)


@pytest.mark.parametrize("length", [40, 100, 240])
def test_repeated_strings_are_removed(documents, texts, length):
    found = substring_dedup.remove_repeats(documents, length=length)
    assert rows_of(found, found.columns) == sorted(brute.repeats(texts, length), key=ANY)


def test_removed_text_is_carried(documents):
    found = substring_dedup.remove_repeats(documents, length=100, carry=True)
    assert found.columns == [*documents.columns, "n_removed"] and found.count() == documents.count()


def test_similarity_components(documents, texts):
    found = ngram_join.similarity_groups(documents)
    assert rows_of(found, found.columns) == sorted(brute.components(texts), key=ANY)


def test_contamination(spark, documents, texts):
    words = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(1, " ".join(words[0].split()[3:30])), (2, "one two"), (3, " ".join(words[5].upper().split()[10:21])), (4, None), (5, ""),
             (3, "three four"), (None, " ".join(words[7].split()[:12])), (12, " ".join(words[0].split()[3:30])), (13, "nowhere to be found")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(documents, table)
    assert rows_of(found, found.columns) == sorted(brute.contamination(texts, items), key=ANY)


@pytest.mark.parametrize("gram", [3, 5, 7])
def test_every_shared_span_is_found(spark, gram):
    rng = np.random.default_rng(gram)
    texts = [(i, " ".join(map(str, rng.integers(0, 4, 60)))) for i in range(40)]
    items = [(i, " ".join(map(str, rng.integers(0, 4, 25)))) for i in range(30)]
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"), gram=gram, span=8)
    assert rows_of(found, found.columns) == sorted(brute.contamination(texts, items, 8), key=ANY)


def test_encoding_agrees_with_the_library(documents, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for key, text in texts:
        ids = library.encode_ordinary(text or "")
        expected.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    found = bpe.encode_documents(documents, with_ids=True)
    assert rows_of(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(expected, key=ANY)
    assert all(len(r.ids) == r.n_tokens for r in found.collect())


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for frame in (substring_dedup.remove_repeats(empty), ngram_join.similarity_groups(empty), bpe.encode_documents(empty),
                  decontaminate.contamination(empty, items)):
        assert frame.count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(5000)) and len(table.slots) == 5000
    assert all(table.get(f"x{i}".encode()) is None for i in range(5000))


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_difference_cover(r):
    period, cover = substring_dedup.difference_cover(r)
    assert {int(a - b) % period for a in cover for b in cover} == set(range(period))
