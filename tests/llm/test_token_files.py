"""Seekable files: exact round trip, selective reads, damage, and agreement with the library on whole texts."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import zstandard
from gridlens.llm import token_files
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def library(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_round_trip(documents, texts):
    folder, manifest = token_files.write_token_files(documents)
    found = token_files.read_token_files(folder, manifest, with_ids=True).collect()
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order]])[:-1].tolist()
    keys = [r.doc_id for r in order]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(k), library(t)) for k, t in texts)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in found)
    wanted = [k for k, _ in texts if k is not None][3]
    some = token_files.read_token_files(folder, manifest, [wanted, 10**9]).collect()
    assert {r.doc_id for r in some} == {wanted} and len(some) == sum(k == wanted for k, _ in texts)


def test_empty_table(empty):
    folder, manifest = token_files.write_token_files(empty)
    assert token_files.read_token_files(folder, manifest).count() == 0


def test_words_may_be_encoded_one_by_one():
    encode = token_files.text_encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    rnd = random.Random(3)
    alphabet = " \n\t 'sabcdéßİΣ漢字12 3$.,!　́̈\x1c\x85<|endoftext|>"
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|>", " <|startoftext|> x"])
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)


def test_format():
    data = [b"", b"\1\0\0\0", b"\2\0\0\0" * 1000]
    out = io.BytesIO()
    writer = token_files.ShardWriter(out)
    for key, ids in zip((None, 5, 9), data):
        writer.add(key, ids)
    writer.close()
    raw = out.getvalue()
    assert raw[-4:] == bytes.fromhex("b1ea928f")  # the published end of a seek table
    reader = token_files.ShardReader(pa.BufferReader(raw))
    assert [reader.read(i) for i in range(3)] == data and reader.find(9) == [2] and reader.find(6) == []
    # Skippable frames are invisible to any other zstandard reader.
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(data)
    hurt = bytearray(raw)
    hurt[int(reader.offsets[1]) + 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.ShardReader(pa.BufferReader(bytes(hurt))).read(1)


def test_plain_text_is_looked_up_by_word_in_lower_case():
    given = []
    encode = token_files.text_encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    known = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, token_files.Memo))
    rnd = random.Random(4)
    parts = ["Straße", "STRASSE", "l'Été", "don't", "IT'S", "can'tx", "12ab", "naïve,", "(x)", "ÿÀ", "--", "a.\nb", "o'clock've", "Öl"]
    for _ in range(2000):
        text = "".join(rnd.choice([*parts, "\t", "\r\n", "'", '"', "0"]) + rnd.choice([" ", "", "  ", "\n"]) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)
        given.append(text)
    # Every word in lower case is encoded once, however it is cased and whatever line it ends.
    assert {w for t in given for w in t.lower().split()} <= set(known) and all(w == w.lower() for w in known)
    for text in ("é x", "a b", "½ ×", "x <|endoftext|> y", "<|x", "\x1c", "\x0b a"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)


def test_every_shard_is_read_by_its_own_task(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat('word ', id) as text")
    merging, number = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (merging, number)}
    spark.conf.set(merging, "false")
    try:
        folder, manifest = token_files.write_token_files(rows)
        shards = manifest.count()
        spark.conf.set(merging, "true")
        spark.conf.set(number, shards)  # the manifest then comes hashed into as many parts
        tasks = token_files.read_token_files(folder, manifest).selectExpr("spark_partition_id() as p").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks == shards > 4
