"""Byte-level BPE encoding and decoding of whole texts with a published rank file.

Two tiers.  A minimal perfect hash over the vocabulary resolves every pre-token that is itself a vocabulary entry;
anything else is merged with a heap of candidate pairs over linked byte positions.  Texts never leave their row:
a job is one scan and one projection, so it scales with the number of input splits and repeats safely after a
lost executor.

Defined results: a missing or empty text has no ids and decodes to nothing; a missing id column value is kept.
Special tokens are not recognised, so their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from gridlens.llm.tables import Memo

#: Entries a task remembers before it starts over.
MEMO_LIMIT = 600_000
_SPACE_RUN = re.compile(r" \s| \Z")


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines; ranks have to be 0..n-1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for word, rank in pairs:
        tokens[int(rank)] = base64.b64decode(word)
    return tokens


class PerfectHash:
    """Minimal perfect hash of a fixed key set: levels of bit arrays, a key sits in the first level where it is alone.

    The position of its bit among all set bits is its slot in 0..n-1.  Slots keep the value and the key, as a
    foreign key may also land on a set bit.
    """

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        if len(set(keys)) != len(keys):
            raise ValueError("keys have to be distinct")
        self.levels: list[tuple[int, int, bytes, list[int]]] = []
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(keys)
        left, used = list(enumerate(keys)), 0
        while left:
            seed, size = len(self.levels), max(64, int(len(left) * spread))
            places = np.array([xxhash.xxh3_64_intdigest(k, seed) % size for _, k in left])
            alone = np.bincount(places, minlength=size) == 1
            rank = (np.cumsum(alone) - alone + used).tolist()
            again = []
            for item, at in zip(left, places.tolist()):
                if alone[at]:
                    self.slots[rank[at]] = (item[1], item[0])
                else:
                    again.append(item)
            self.levels.append((seed, size, alone.tobytes(), rank))
            left, used = again, used + len(left) - len(again)

    def get(self, key: bytes) -> int | None:
        for seed, size, alone, rank in self.levels:
            at = xxhash.xxh3_64_intdigest(key, seed) % size
            if alone[at]:
                held, value = self.slots[rank[at]]
                return value if held == key else None
        return None


def heap_merge(piece: bytes, ranks: dict[bytes, int], single: list[int]) -> list[int]:
    """Merge the lowest ranked neighbouring pair, leftmost first, until none is left.

    ``single`` has the rank of every byte.  A heap entry is rank and position in one integer.
    """
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    get = ranks.get
    ids = [single[b] for b in piece]
    following = list(range(1, n + 1))
    preceding = list(range(-1, n))
    best = [-1] * (n + 1)  # the heap entry that holds for a position just now
    heap = []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            best[i] = entry = r << shift | i
            heap.append(entry)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        if best[i] != entry:
            continue  # one of its sides has changed meanwhile
        middle = following[i]
        end = following[i] = following[middle]
        preceding[end] = i
        best[middle] = ids[middle] = -1
        ids[i] = entry >> shift
        best[i] = -1
        if end < n:
            r = get(piece[i:following[end]])
            if r is not None:
                best[i] = entry = r << shift | i
                heappush(heap, entry)
        before = preceding[i]
        if before >= 0:
            r = get(piece[before:end])
            if r is None:
                best[before] = -1
            else:
                best[before] = entry = r << shift | before
                heappush(heap, entry)
    return [i for i in ids if i >= 0]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.known = PerfectHash(self.tokens)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.pre_tokens = Memo(self._pre_token, MEMO_LIMIT)
        self.words = Memo(self._word, MEMO_LIMIT)

    def _pre_token(self, text: str) -> bytes:
        piece = text.encode()
        whole = self.known.get(piece)
        ids = heap_merge(piece, self.ranks, self.single) if whole is None else [whole]
        return array("I", ids).tobytes()

    def _run(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.split(text)))

    def _word(self, word: str) -> bytes:
        # A space and letters are one pre-token; the alphabet is bounded as Unicode tables differ in age.
        if word.isalpha() and max(word) < "\u0250":
            return self.pre_tokens[" " + word]
        return self._run(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        Where every space stands before a visible character, a pre-token begins at each space, so the text can be
        cut there and words be looked up whole.
        """
        if _SPACE_RUN.search(text):
            return self._run(text)
        first, *rest = text.split(" ")
        return self._run(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, *, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, digests of the ids and of the bytes decoded from them, optionally the ids.

    ``pattern`` has to split before a space that a visible character follows, as the published patterns do.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    columns = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = dict(columns.dtypes)["key"]
    schema = "key " + kind + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path, pattern)
            counts, digests, decoded, all_ids = [], [], [], []
            for value in batch.column("text"):
                raw = codec.encode(value.as_py() or "")
                ids = np.frombuffer(raw, dtype="<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            out = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                   pa.array(decoded, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, all_ids)], dtype=np.int64)
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return columns.mapInArrow(run, schema).withColumnRenamed("key", key)
