"""Alignment of two tokenizers: which tokens of one overlap which of the other, and which pairs are the usual ones.

Both tokenizers cut the same bytes.  Between two ends of tokens, of either side, lies one *link*: a token of side A
and a token of side B that overlap.  Counting how often each pair of ids is linked in the whole corpus, and giving
every document the counts of its own links back, is a group by whose keys are skewed and whose groups come in
both directions; it is done over sorted runs:

1. *Spill.*  A task packs its links into 64-bit numbers (bucket, B id, A id, document in the run), sorts some
   millions at a time, and writes them as a *run*: per bucket, frames of (key, document, times), differences of
   sorted keys, compressed by zstd.  The bucket is a radix of the B id, so all pairs of a B id are in one bucket.
2. *Count.*  A task merges up to `GROUP_RUNS` runs of one bucket by a heap over the last keys of their loaded frames,
   adds up equal keys, and writes a run of counts.  Such runs are merged in further levels until a bucket has one.
   A B id that makes up much of the corpus is spread over the groups of runs, and what is left of it after the
   first level has one record per A id.
3. *Maxima.*  Keys run by B id first, so the pairs of a B id come together and its highest count is known when they end.
4. *Back.*  The runs of a group stream once more, beside the counts of their bucket, and every run gets the sums of
   its own documents, which are added over the buckets.

No document is gathered anywhere, and a task holds frames of its runs and the sums of the documents of a group.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.llm.common import bounded, safe_pieces, text_of
from hinloom.llm.vocabularies import LONGEST_STRETCH, PIECE_CHARS, ids_of
from hinloom.runtime import materialize

# Radix of the B id; a packed link has 6 bits of it, 34 of the pair and 24 of the document.
BUCKETS = 64
KEY_BITS = 34
DOC_BITS = 24

# Links of a run, records of a frame, and runs merged by one task.
RUN_LINKS = 1 << 21
FRAME = 1 << 16
GROUP_RUNS = 32

# Documents of a run, and bytes of text aligned at once.
RUN_DOCS = 1 << 20
CHUNK_BYTES = 1 << 20

# Words of side B that a worker keeps with their ids.
KEPT_WORDS = 1 << 17
KEPT_LENGTH = 32


# --- the two sides -------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: visible Latin-1 for itself, the others from 256 upwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in set(visible)]
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteSide:
    """Side A: a byte-level BPE ``.json``; special strings in a text are plain text."""

    def __init__(self, path: str):
        self.encoder = ids_of(path)
        with open(path) as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in letters for c in token):
                self.tokens[number] = bytes(letters[c] for c in token)

    def _library(self, text: str) -> np.ndarray:
        library = self.encoder.library
        library.encode_special_tokens = True
        try:
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            library.encode_special_tokens = False

    def __call__(self, text: str) -> np.ndarray:
        text = " " + text
        fast = self.encoder.fast
        if fast is None:
            return self._library(text)
        parts = [
            fast.encode_to_numpy(piece, disallowed_special=()) if len(piece) <= LONGEST_STRETCH else self._library(piece)
            for piece in safe_pieces(text, PIECE_CHARS)
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class _Words(dict):
    """Ids of words, as bytes; cleared whole when full, and a long word is not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class PieceSide:
    """Side B: a ``.model`` of `sentencepiece`, which puts a blank before the text.

    Where no piece of the vocabulary holds a blank behind another character, no merge crosses the place before a
    blank, and a text is encoded word by word.
    """

    _UNIT = re.compile(" *[^ ]+| +")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        blank = self.model.piece_to_id("▁")
        self.by_word = not self.model.is_unknown(blank) and all(re.fullmatch("▁*[^▁]*", p) for p in pieces)
        # An empty word is the blank that the model itself puts before a text.
        self.words = _Words(lambda word: self._ids(word).tobytes() if word else np.array([blank], np.uint32).tobytes())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word or "▁" in text:  # the sign itself would be taken for a blank
            return self._ids(text)
        words = text.split(" ")
        if "" in words:
            words = [unit[1:] for unit in self._UNIT.findall(" " + text)]
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)


_sides: dict[tuple[str, str], tuple[ByteSide, PieceSide, "Names"]] = {}


def sides(a: str, b: str) -> tuple[ByteSide, PieceSide, "Names"]:
    """Both sides, once per Python worker."""
    if (a, b) not in _sides:
        one, two = ByteSide(a), PieceSide(b)
        _sides[a, b] = one, two, Names(len(one.tokens), len(two.tokens))
    return _sides[a, b]


class Names:
    """Decimal ids with what follows them: ``,`` inside a group, ``|`` after its A ids, ``;`` after its B ids."""

    def __init__(self, size_a: int, size_b: int):
        self.offset = 2 * size_a
        names = [b"%d%s" % (i, end) for i in range(size_a) for end in (b",", b"|")]
        names += [b"%d%s" % (i, end) for i in range(size_b) for end in (b",", b";")]
        self.names = np.array(names, object)


class Aligned:
    """Links, groups and their digests of some texts, worked on as one sequence of bytes."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes: list[int], lengths: tuple, names: Names):
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        ends_a, ends_b = np.cumsum(lengths[0][ids_a]), np.cumsum(lengths[1][ids_b])
        doc_ends = np.cumsum(sizes)
        mark_a, mark_b = np.zeros(doc_ends[-1] + 1, bool), np.zeros(doc_ends[-1] + 1, bool)
        mark_a[ends_a] = True
        mark_b[ends_b] = True
        ends = np.flatnonzero(mark_a | mark_b)
        in_a, in_b = mark_a[ends], mark_b[ends]
        both = in_a & in_b
        # The tokens of a link are those that have not ended before it.
        self.a = ids_a[np.cumsum(in_a) - in_a]
        self.b = ids_b[np.cumsum(in_b) - in_b]
        last = np.searchsorted(ends, doc_ends, "right")
        self.n_links = np.diff(last, prepend=0)
        groups = np.cumsum(both)
        self.n_groups = np.diff(groups[last - 1], prepend=0)
        self.digests = self._digests(ids_a, ids_b, groups - both, in_a, in_b, both, a, b, names)

    @staticmethod
    def _digests(ids_a, ids_b, group, in_a, in_b, both, a, b, names) -> list[str]:
        group_a, group_b = group[in_a], group[in_b]
        count = int(group[-1]) + 1
        sum_a, sum_b = np.cumsum(np.bincount(group_a, minlength=count)), np.cumsum(np.bincount(group_b, minlength=count))
        written = np.empty(len(ids_a) + len(ids_b), np.int64)
        before_b = np.concatenate([[0], sum_b[:-1]])
        written[np.arange(len(ids_a)) + before_b[group_a]] = ids_a.astype(np.int64) * 2 + both[in_a]
        written[np.arange(len(ids_b)) + sum_a[group_b]] = names.offset + ids_b.astype(np.int64) * 2 + both[in_b]
        text = names.names[written].tolist()
        edges = np.cumsum([0, *(len(x) + len(y) for x, y in zip(a, b, strict=True))]).tolist()
        return [hashlib.sha256(b"".join(text[i:j])[:-1]).hexdigest() for i, j in zip(edges, edges[1:], strict=False)]


# --- runs ------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the same weight together: most are zero."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(data: memoryview, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def frame(keys: np.ndarray, others: np.ndarray, numbers: np.ndarray) -> bytes:
    """Sorted keys, small and large numbers of a record, compressed."""
    data = _planes(np.diff(keys.astype("<u8"), prepend=np.uint64(0)))
    data += _planes(others.astype("<u4")) + _planes(numbers.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(data)


def unframe(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = len(plain) // 20
    keys = np.cumsum(_values(plain[: 8 * n], "<u8"), dtype=np.uint64)
    return keys, _values(plain[8 * n : 12 * n], "<u4"), _values(plain[12 * n :], "<u8")


def frames(keys: np.ndarray, others: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    return [frame(keys[i : i + FRAME], others[i : i + FRAME], numbers[i : i + FRAME]) for i in range(0, len(keys), FRAME)]


def spilled(packed: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Frames per bucket of packed links; equal (pair, document) become one record."""
    packed = np.sort(packed)
    starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    times = np.diff(np.append(starts, len(packed)))
    packed = packed[starts]
    buckets = packed >> np.uint64(KEY_BITS + DOC_BITS)
    keys = (packed >> np.uint64(DOC_BITS)) & np.uint64((1 << KEY_BITS) - 1)
    docs = packed & np.uint64((1 << DOC_BITS) - 1)
    edges = np.searchsorted(buckets, np.arange(BUCKETS + 1))
    for bucket, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
        if i < j:
            yield bucket, frames(keys[i:j], docs[i:j], times[i:j])


class Cursor:
    """The records of a run in order, one loaded frame at a time."""

    def __init__(self, run: list[bytes]):
        self.run = iter(run)
        self.last: int | None = None
        self._load()

    def _load(self) -> None:
        data = next(self.run, None)
        if data is None:
            self.last = None
        else:
            self.records = unframe(data)
            self.last = int(self.records[0][-1])

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Records with keys up to ``bound`` that were not taken before."""
        parts = []
        while self.last is not None:
            cut = np.searchsorted(self.records[0], np.uint64(bound), "right")
            if cut:
                parts.append(tuple(column[:cut] for column in self.records))
            if cut < len(self.records[0]):
                self.records = tuple(column[cut:] for column in self.records)
                break
            self._load()
        if len(parts) < 2:
            return parts[0] if parts else None
        return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def counted(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in order with the sums of their numbers, by a heap over the last loaded key of every run."""
    cursors = [Cursor(run) for run in runs]
    heap = [(c.last, i) for i, c in enumerate(cursors) if c.last is not None]
    heapq.heapify(heap)
    while heap:
        bound, i = heapq.heappop(heap)
        if bound == cursors[i].last:  # otherwise this frame has gone with an earlier bound
            taken = [t for t in (c.take(bound) for c in cursors) if t is not None]
            keys = np.concatenate([t[0] for t in taken])
            numbers = np.concatenate([t[2] for t in taken])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield keys[starts], np.add.reduceat(numbers[order], starts)
        if cursors[i].last is not None:
            heapq.heappush(heap, (cursors[i].last, i))


def with_best(windows: Iterator[tuple[np.ndarray, np.ndarray]], size_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Add 1 for the pairs that have the highest count of their B id; what is held back is one B id at most."""

    def marked(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = keys // np.uint64(size_a)
        starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(side))))
        return keys, (counts == most).astype(np.uint32), counts

    held = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for window in windows:
        keys, counts = (np.concatenate(x) for x in zip(held, window, strict=True))
        side = keys // np.uint64(size_a)
        done = np.searchsorted(side, side[-1])
        if done:
            yield marked(keys[:done], counts[:done])
        held = keys[done:], counts[done:]
    if len(held[0]):
        yield marked(*held)


# --- jobs ------------------------------------------------------------------------

_SPILL = (
    "run long, bucket int, frames array<binary>, place int, doc_id long, n_a long, n_b long, n_groups long, "
    "n_links long, groups_sha256 string"
)
_RUN = "bucket int, group int, frames array<binary>"


def _spill(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of documents (without a bucket) and rows of runs (with one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b, names = sides(a, b)
        size_a = len(side_a.tokens)
        if size_a * len(side_b.tokens) >= 1 << KEY_BITS:
            raise ValueError("vocabularies too large for packed pairs")
        lengths = tuple(np.array([len(t) for t in side.tokens]) for side in (side_a, side_b))
        number = TaskContext.get().partitionId() << 24
        place, links, held = 0, [], 0

        def chunk(ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal held
            one, two, sizes, at = [], [], [], []
            for k, text in enumerate(texts):
                if not text:
                    continue
                data = (" " + text).encode()
                x, y = side_a(text), side_b(text)
                joined = (b"".join([side.tokens[i] for i in ids_.tolist()]) for side, ids_ in ((side_a, x), (side_b, y)))
                if all(j == data for j in joined):
                    one.append(x)
                    two.append(y)
                    sizes.append(len(data))
                    at.append(k)
            zeros = [0] * len(texts)
            columns = {"n_a": zeros, "n_b": zeros[:], "n_groups": zeros[:], "n_links": zeros[:]}
            digests = [""] * len(texts)
            if one:
                found = Aligned(one, two, sizes, lengths, names)
                for k, x, y, groups, n, digest in zip(
                    at, one, two, found.n_groups.tolist(), found.n_links.tolist(), found.digests, strict=True
                ):
                    columns["n_a"][k], columns["n_b"][k] = len(x), len(y)
                    columns["n_groups"][k], columns["n_links"][k], digests[k] = groups, n, digest
                doc = np.repeat(np.array(at, np.uint64) + np.uint64(place), found.n_links)
                key = found.b.astype(np.uint64) * np.uint64(size_a) + found.a
                bucket = found.b.astype(np.uint64) % np.uint64(BUCKETS)
                links.append(((bucket << np.uint64(KEY_BITS) | key) << np.uint64(DOC_BITS)) | doc)
                held += len(doc)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(texts), pa.int64()),
                    pa.nulls(len(texts), pa.int32()),
                    pa.nulls(len(texts), pa.list_(pa.binary())),
                    pa.array(range(place, place + len(texts)), pa.int32()),
                    pa.array(ids, pa.int64()),
                    *[pa.array(c, pa.int64()) for c in columns.values()],
                    pa.array(digests, pa.string()),
                ],
                names=_NAMES,
            )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, place, links, held
            if links:
                runs = list(spilled(np.concatenate(links)))
                empty = [pa.nulls(len(runs), t) for t in (pa.int32(), *[pa.int64()] * 5, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(runs), pa.int64()),
                        pa.array([bucket for bucket, _ in runs], pa.int32()),
                        pa.array([parts for _, parts in runs], pa.list_(pa.binary())),
                        *empty,
                    ],
                    names=_NAMES,
                )
            number, place, links, held = number + 1, 0, [], 0

        for whole in batches:
            for batch in bounded(whole):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                start = size = 0
                for k in range(batch.num_rows):
                    size += len(texts[k].as_buffer())
                    if size >= CHUNK_BYTES or k + 1 == batch.num_rows:
                        part = texts.slice(start, k + 1 - start).to_pylist()
                        yield chunk(ids[start : k + 1], part)
                        place += len(part)
                        start, size = k + 1, 0
                        if held >= RUN_LINKS or place >= RUN_DOCS:
                            yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, _SPILL)


_NAMES = ["run", "bucket", "frames", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _one_run(bucket: int, group: int, parts: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int32()),
            "group": pa.array([group], pa.int32()),
            "frames": pa.array([parts], pa.list_(pa.binary())),
        }
    )


def _joined(windows: Iterator[tuple]) -> list[bytes]:
    """Frames of about `FRAME` records from windows of any size."""
    out: list[bytes] = []
    held: list[tuple] = []
    size = 0
    for window in windows:
        held.append(window if len(window) == 3 else (window[0], np.zeros(len(window[0]), np.uint32), window[1]))
        size += len(window[0])
        if size >= FRAME:
            out += frames(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        out += frames(*(np.concatenate(c) for c in zip(*held, strict=True)))
    return out


def count_pairs(runs: DataFrame, groups: int, size_a: int, group_runs: int = GROUP_RUNS) -> DataFrame:
    """One run of (pair, whether it is the best of its B id, count) per bucket, from runs dealt to ``groups``."""

    def merge(final: bool):
        def run(table: pa.Table) -> pa.Table:
            windows = counted(table.column("frames").to_pylist())
            if final:
                windows = with_best(windows, size_a)
            return _one_run(table.column("bucket")[0].as_py(), table.column("group")[0].as_py(), _joined(windows))

        return run

    level = runs.select("bucket", "group", "frames")
    while True:
        final = groups == 1
        dealt = level.repartition(BUCKETS * min(groups, 64), "bucket", "group").groupBy("bucket", "group")
        level = materialize(dealt.applyInArrow(merge(final), _RUN), "pair-counts")
        if final:
            return level
        groups = -(-groups // group_runs)
        level = level.withColumn("group", F.pmod("group", F.lit(groups)).cast("int"))


def _given_back(runs: DataFrame, counts: DataFrame, groups: int) -> DataFrame:
    """``run, frames``: per run and bucket, sums of (best links, counts) of the run's documents."""

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        cursors = [Cursor(run) for run in left.column("frames").to_pylist()]
        sums = [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for n in left.column("docs").to_pylist()]
        for data in right.column("frames")[0].as_py() if left.num_rows else []:
            keys, best, count = unframe(data)
            for cursor, (bests, totals) in zip(cursors, sums, strict=True):
                taken = cursor.take(int(keys[-1]))
                if taken is not None:
                    at = np.searchsorted(keys, taken[0])
                    times = taken[2].astype(np.int64)
                    np.add.at(bests, taken[1], times * best[at])
                    np.add.at(totals, taken[1], times * count[at].astype(np.int64))
        out = []
        for bests, totals in sums:
            some = np.flatnonzero(totals)
            out.append(frame(some, bests[some], totals[some]))
        return pa.table({"run": left.column("run"), "sums": pa.array(out, pa.binary())})

    group_of = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    copies = counts.select(F.col("bucket").alias("of_bucket"), group_of.alias("of_group"), F.col("frames"))
    parts = BUCKETS * min(groups, 64)
    left = runs.select("bucket", "group", "run", "frames", "docs").repartition(parts, "bucket", "group")
    right = copies.repartition(parts, "of_bucket", "of_group")
    return left.groupBy("bucket", "group").cogroup(right.groupBy("of_bucket", "of_group")).applyInArrow(
        stream, "run long, sums binary"
    )


def _added(sums: DataFrame) -> DataFrame:
    """``run, place, n_best, count_sum``: the sums of the documents of each run over all buckets."""

    def add(table: pa.Table) -> pa.Table:
        parts = [unframe(s.as_py()) for s in table.column("sums")]
        size = max((int(p[0][-1]) + 1 for p in parts if len(p[0])), default=0)
        best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for places, bests, totals in parts:
            best[places.astype(np.int64)] += bests
            total[places.astype(np.int64)] += totals.astype(np.int64)
        some = np.flatnonzero(total)
        return pa.table(
            {
                "run": pa.array(np.full(len(some), table.column("run")[0].as_py()), pa.int64()),
                "place": pa.array(some, pa.int32()),
                "n_best": pa.array(best[some], pa.int64()),
                "count_sum": pa.array(total[some], pa.int64()),
            }
        )

    return sums.groupBy("run").applyInArrow(add, "run long, place int, n_best long, count_sum long")


def align(docs: DataFrame, a: str, b: str, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Alignment of the tokens of two tokenizers on each text of ``docs`` (``doc_id, text``).

    ``a`` is a byte-level BPE ``.json`` that encodes a blank and the text, ``b`` a ``.model`` that puts the blank before the
    text itself; neither adds special tokens, and their strings in a text are plain text.  Returns doc_id, n_a, n_b,
    n_groups (stretches between byte offsets where tokens of both sides end), n_links (pairs of occurrences that
    overlap), n_best (links whose pair of ids has the highest count, over the corpus, of the pairs with its B id, ties
    included), count_sum (corpus counts of the pairs, summed over the links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    A null or empty text, and one that a side does not give back byte by byte, has no tokens: zeros and ''.  Texts of
    any length are taken whole; repeated rows count once each; a null doc_id stays null and its text counts;
    other columns are ignored; no documents give no rows.
    """
    written = materialize(_spill(docs, a, b), "links")
    of_docs = written.where("bucket is null").drop("bucket", "frames")
    per_run = of_docs.groupBy("run").agg((F.max("place") + 1).alias("docs"))
    count = per_run.count()
    if not count:
        none = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
        return of_docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256")
    groups = -(-count // group_runs)
    group = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")
    runs = written.where("bucket is not null").select("run", "bucket", "frames").join(per_run, "run").withColumn("group", group)
    size_a = len(sides(a, b)[0].tokens)
    counts = count_pairs(runs, groups, size_a, group_runs)
    sums = materialize(_added(materialize(_given_back(runs, counts, groups), "sums")), "document-sums")
    zero = F.lit(0).cast("long")
    return of_docs.join(sums, ["run", "place"], "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
