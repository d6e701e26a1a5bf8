"""Token ids in seekable zstandard files.

A shard holds documents in ascending id order.  Every document is a zstandard frame of its own (ids as little-endian
32-bit integers), so one can be read without its neighbours.  After the last one come a skippable frame with the
document ids and the published seek table: a skippable frame with each frame's compressed and decompressed size and
the lower half of its XXH64, closed by a fixed-size footer.  A reader fetches the footer, the table, and the byte ranges
of the documents it wants, and checks what it decompressed.

Rows are range partitioned by id, and by a hash of the text among equal ids, before they are encoded: order costs one
shuffle of the text, and no id is too frequent for one task.  A task writes under a name of its own and renames, so a
repeated task leaves one file.  One row per shard is kept as manifest; a document's place in the whole stream follows
from sums over shards.

Defined results: a missing or empty text is the end id alone; missing ids come first; repeated rows are each stored.  A
document of 4 GiB of ids does not fit the format and raises an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.tables import Memo, stored
from gridlens.session import ensure_checkpoint_dir

# Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = "<IBI"
FOOTER_SIZE = struct.calcsize(FOOTER)
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
INDEX = np.dtype([("key", "<i8"), ("missing", "u1")])
MEMO_LIMIT = 600_000


def _steps(name: str, **more) -> dict:
    return {"type": name, **more}


#: Normalizer and pre-tokenizer of the published word tokenizer.  What they do to plain text is known, see text_encoder.
NORMALIZER = _steps("Sequence", normalizers=[
    _steps("NFC"), _steps("Replace", pattern={"Regex": r"\s+"}, content=" "), _steps("Lowercase")])
PRE_TOKENIZER = _steps("Sequence", pretokenizers=[
    _steps("Split", pattern={"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, behavior="Removed", invert=True),
    _steps("ByteLevel", add_prefix_space=False, trim_offsets=True, use_regex=False)])
#: Anything but white space, visible ASCII and letters of Latin-1, none of which NFC changes.
_NOT_PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]").search
#: The pre-tokenizer's pattern for plain text in lower case.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def text_encoder(path: str, end_id: int) -> Callable[[str], bytes]:
    """Encoder of whole texts by the tokenizers library, for a tokenizer that cuts at spaces and drops them.

    What stands between two spaces is then encoded once per task and looked up afterwards.  With the published
    tokenizer's steps, plain text is lower-cased and cut into pre-tokens here, and the library's model is given each
    different one once, which leaves out the library's costly bookkeeping of offsets.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    end, memo = np.array([end_id], "<u4").tobytes(), {}
    added = tokenizer.get_added_tokens_decoder().values()
    specials = [t.content for t in added]
    known = (tokenizer.normalizer is not None and json.loads(tokenizer.normalizer.__getstate__()) == NORMALIZER
             and tokenizer.pre_tokenizer is not None and json.loads(tokenizer.pre_tokenizer.__getstate__()) == PRE_TOKENIZER
             and tokenizer.truncation is None and tokenizer.padding is None and not any(t.normalized for t in added))
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()

    def pre_token(piece: str) -> bytes:
        piece = piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(piece)]).tobytes()

    def word(text: str) -> bytes:
        # Letters are one pre-token.
        found = [text] if text.isalpha() else _PRE_TOKENS(text)
        return pre_token(text) if len(found) == 1 else b"".join(map(words.__getitem__, found))

    words = Memo(word, MEMO_LIMIT)

    def encode(text: str) -> bytes:
        if known and not _NOT_PLAIN(text) and not any(t in text for t in specials):
            return b"".join(map(words.__getitem__, text.lower().split())) + end
        parts = text.split(" ")
        new = list(set(parts).difference(memo))
        if len(memo) + len(new) > MEMO_LIMIT:
            memo.clear()
            new = list(set(parts))
        for part, found in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            memo[part] = array("I", found.ids).tobytes()
        return b"".join(map(memo.__getitem__, parts)) + end

    return encode


class ShardWriter:
    """One shard; ``close`` writes index and seek table."""

    def __init__(self, out, level: int = 3):
        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[tuple[int, int]] = []
        self.tokens = 0

    def add(self, key: int | None, ids: bytes) -> None:
        if len(ids) >= 2**32:
            raise ValueError("a document's ids have to be shorter than 4 GiB")
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.frames.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.keys.append((key or 0, key is None))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.keys, INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = np.array(self.frames, ENTRY).tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + FOOTER_SIZE) + table)
        self.out.write(struct.pack(FOOTER, len(self.frames), CHECKSUMS, SEEKABLE))


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack(FOOTER, self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = self._at(size - FOOTER_SIZE - frames * ENTRY.itemsize, frames * ENTRY.itemsize)
        self.entries = np.frombuffer(table, ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        index = self._at(int(self.offsets[-2]) + 8, int(self.entries["packed"][-1]) - 8)
        self.index = np.frombuffer(index, INDEX)
        self.tokens = self.entries["size"][:-1].astype(np.int64) // 4
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def find(self, key: int) -> list[int]:
        """Places of a document id; several if it was stored more than once."""
        first = int(self.index["missing"].sum())
        low, high = (np.searchsorted(self.index["key"][first:], key, side=s) + first for s in ("left", "right"))
        return list(range(int(low), int(high)))

    def read(self, place: int) -> bytes:
        """Ids of the document at a place, checked."""
        _, size, check = self.entries[place]
        frame = self._at(int(self.offsets[place]), int(self.entries["packed"][place]))
        ids = self.decompressor.decompress(frame, max_output_size=max(int(size), 1))
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {place} is damaged")
        return ids


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, *, folder: str | None = None, path: str | None = None, end_id: int = 2,
                      key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encode every text and write shards; the folder and the manifest (shard, file, n_docs, n_tokens, start).

    ``folder`` has to be one that all executors reach; it lies in the shared checkpoint folder by default.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4()}"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, out = TaskContext.get(), None, None
        shard = task.partitionId()
        system, base = _opened(folder)
        name, draft = f"{base}/shard-{shard:07d}.zst", f"{base}/.draft-{shard:07d}-{task.taskAttemptId()}"
        encode = None
        for batch in batches:
            if writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(draft)
                writer, encode = ShardWriter(out), text_encoder(path, end_id)
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                writer.add(k, encode(t.as_py()))
        if writer is not None:
            writer.close()
            out.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([os.path.basename(name)]), pa.array([len(writer.keys)], pa.int64()),
                 pa.array([writer.tokens], pa.int64())], names=["shard", "file", "n_docs", "n_tokens"])

    manifest = stored(rows.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long"))
    # One row per shard: the only window without a partition runs over these.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("start"))
    return folder, manifest.join(starts, "shard")


def read_token_files(folder: str, manifest: DataFrame, keys: list[int] | None = None, *, with_ids: bool = False) -> DataFrame:
    """Per stored document: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, the ids.

    With ``keys`` only those documents are fetched and decompressed.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{base}/{file}") as source:
                    shard = ShardReader(source)
                    starts = start + np.cumsum(shard.tokens) - shard.tokens
                    places = range(len(shard.index)) if keys is None else [p for k in keys for p in shard.find(k)]
                    for at in range(0, len(places), 4096):
                        part = places[at:at + 4096]
                        ids = [shard.read(p) for p in part]
                        columns = [
                            pa.array([None if shard.index["missing"][p] else int(shard.index["key"][p]) for p in part], pa.int64()),
                            pa.array(starts[list(part)], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                            pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    # A shard is a task's work again.  Ranges, as the rows may come hashed by shard: Spark then takes that order for the one
    # asked for and puts the small rows together in one task.
    shards = max(1, manifest.count())
    return manifest.select("shard", "file", "start").repartitionByRange(shards, "shard").mapInArrow(read, schema)
