"""Byte-level BPE encoding and decoding by a rank file.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash: one displacement per small bucket of
keys, as many slots as keys, and one comparison with the entry in the slot.  All other pre-tokens are merged by
rank with a heap over linked bytes.  The tables are made once on the driver and broadcast; they have the size of
the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.llm.common import UNIT, WHITE_SPACE, arrow_map, safe_pieces, text_of
from hinloom.llm.vocabularies import read_ranks

# Keys per bucket of the perfect hash.
BUCKET_KEYS = 4

# Ids of texts between safe cuts are remembered per Python worker, so many at most and no longer ones.
REMEMBERED = 800_000
REMEMBERED_CHARS = 64

# Texts are encoded in stretches of this many characters, cut where the result cannot change.
STRETCH = 1 << 20

_MIX = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _slot(key_hash: int, displacement: int, slots: int) -> int:
    mixed = ((key_hash ^ (displacement * _MIX)) * _MIX) & _WORD
    return (mixed ^ (mixed >> 32)) % slots


class PerfectHash:
    """A minimal perfect hash over distinct byte strings.

    ``displacements[bucket]`` shifts the keys of a bucket to free slots; for a bucket of one key it may be
    ``-slot - 1``, the slot itself, so that the last free slots are filled without a search.
    """

    def __init__(self, keys: list[bytes]):
        self.slots = len(keys)
        self.buckets = max(1, -(-len(keys) // BUCKET_KEYS))
        self.displacements = [0] * self.buckets
        self.key_at: list[bytes] = [b""] * self.slots
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            value = xxhash.xxh64_intdigest(key)
            members[value % self.buckets].append((value, key))
        free = bytearray(b"\1") * self.slots
        single: list[int] = []
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if len(own) < 2:
                single += [bucket] * len(own)
                continue
            displacement = 0
            while True:
                places = {_slot(value, displacement, self.slots) for value, _ in own}
                if len(places) == len(own) and all(free[p] for p in places):
                    break
                displacement += 1
            self.displacements[bucket] = displacement
            for value, key in own:
                place = _slot(value, displacement, self.slots)
                free[place] = 0
                self.key_at[place] = key
        left = (place for place in range(self.slots) if free[place])
        for bucket, place in zip(single, list(left), strict=True):
            self.displacements[bucket] = -place - 1
            self.key_at[place] = members[bucket][0][1]

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1 for a string that is no key."""
        if not self.slots:
            return -1
        value = xxhash.xxh64_intdigest(key)
        displacement = self.displacements[value % self.buckets]
        place = -displacement - 1 if displacement < 0 else _slot(value, displacement, self.slots)
        return place if self.key_at[place] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of a piece: the pair of lowest rank is merged first, of equal ones the leftmost.

    A part is known by where it starts; ``after`` and ``before`` link the starts.  Heap entries of pairs that a
    merge has changed are skipped when they come up.
    """
    size = len(piece)
    shift = max(14, size.bit_length())  # keeps the heap entries of usual pieces small numbers
    place = (1 << shift) - 1
    after = list(range(1, size + 2))
    before = list(range(-1, size))
    rank_of = ranks.get
    pair = [rank_of(piece[i : i + 2], -1) for i in range(size)]  # the last is no pair
    pair[-1] = -1
    heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & place
        if pair[i] != entry >> shift:
            continue
        middle = after[i]
        end = after[middle]
        after[i] = end
        before[end] = i
        pair[middle] = -1
        if end < size:
            pair[i] = rank = rank_of(piece[i : after[end]], -1)
            if rank >= 0:
                heappush(heap, rank << shift | i)
        else:
            pair[i] = -1
        start = before[i]
        if start >= 0:
            pair[start] = rank = rank_of(piece[start:end], -1)
            if rank >= 0:
                heappush(heap, rank << shift | start)
    tokens = []
    i = 0
    while i < size:
        end = after[i]
        tokens.append(piece[i:end])
        i = end
    return tokens


class _Remembered(dict):
    """Little-endian ids of units of text; a unit not seen yet is encoded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        ids = self.codec.encode_unit(unit)
        if len(unit) <= REMEMBERED_CHARS:
            self[unit] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary; made on the driver, sent to the workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.id_at = [ranks[key].to_bytes(4, "little") for key in self.hash.key_at]
        # `\s` is spelled out, since engines differ on the separators below 0x20.
        self.pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]")
        self.pattern = self.pattern.replace(r"\S", f"[^{WHITE_SPACE}]")
        self._start()

    def _start(self) -> None:
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pre_tokens = regex.compile(self.pattern)
        self.units = _Remembered(self)
        self.words: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        kept = ("ranks", "hash", "id_at", "pattern")
        return {k: v for k, v in self.__dict__.items() if k in kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def encode_word(self, word: str) -> bytes:
        piece = word.encode()
        slot = self.hash.find(piece)
        if slot >= 0:
            return self.id_at[slot]
        return b"".join([self.packed[token] for token in merge(piece, self.ranks)])

    def encode_unit(self, unit: str) -> bytes:
        # A blank and letters are one pre-token.
        if unit[0] == " " and unit[1:].isalpha():
            return self.encode_word(unit)
        out = []
        for word in self.pre_tokens.findall(unit):
            ids = self.words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= REMEMBERED_CHARS:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, stretch by stretch."""
        for stretch in safe_pieces(text, STRETCH):
            if len(self.units) > REMEMBERED:
                self.units.clear()
            if len(self.words) > REMEMBERED:
                self.words.clear()
            yield b"".join(map(self.units.__getitem__, UNIT.findall(stretch)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode every text, then decode the ids.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256
    (of the decoded bytes), a row per row of ``docs``.  A null text counts as empty and has no ids; very long texts
    are encoded whole, stretch by stretch; repeated rows give repeated rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(read_ranks(rank_file), pattern))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = shared.value
        counts, ids_sums, text_sums = [], [], []
        for text in batch.column(1):
            count, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
            for ids in codec.encode(text.as_py()):
                count += len(ids) // 4
                ids_sum.update(ids)
                text_sum.update(codec.decode(ids))
            counts.append(count)
            ids_sums.append(ids_sum.hexdigest())
            text_sums.append(text_sum.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return arrow_map(texts, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
