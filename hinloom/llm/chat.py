"""Conversations in reply order, with quotations replaced by links to the messages they come from.

A line's quote level is the number of ``>`` signs at its start.  The lines of a level form passages; passages are
normalised, hashed, and joined to the first message of the conversation that has the passage as its own text.  A
message replies to the earlier message that most of its quoted characters of the lowest level come from.

Nothing gathers a conversation: first messages are found by a map-side minimum, replies by sums, threads by pointer
jumping over written tables, and positions by a range sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.llm.common import bounded, text_of
from hinloom.runtime import materialize, ordered_ids

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]*)+)")
# A line like "On Monday, Ann wrote:" right above a quotation belongs to it.
_ATTRIBUTION = re.compile(r"^\s*(on\b.*\bwrote|.{0,80}\bwrote|.{0,80}\bsaid)\s*:\s*$", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


def parse(text: str) -> list[tuple[int, str]]:
    """(quote level, line) of each line, with the quote marks taken off."""
    lines = []
    for line in text.split("\n"):
        mark = _QUOTE.match(line)
        lines.append((mark.group(1).count(">"), line[mark.end() :]) if mark else (0, line))
    # An attribution is part of the quotation below it.
    for i in range(len(lines) - 1):
        level, line = lines[i]
        if lines[i + 1][0] > level and _ATTRIBUTION.match(line):
            lines[i] = (lines[i + 1][0], "")
    return lines


def own_text(lines: list[tuple[int, str]]) -> str:
    """The message without its quotations; blank lines at the ends and runs of them where a quotation was go."""
    kept: list[str] = []
    cut = False
    for level, line in lines:
        if level:
            cut = True
            continue
        if cut and not line.strip() and (not kept or not kept[-1].strip()):
            continue
        cut = False
        kept.append(line)
    return "\n".join(kept).strip("\n") if any(level for level, _ in lines) else "\n".join(kept)


def _normal(text: str) -> str:
    return _BLANK.sub(" ", text).strip().lower()


def passages(lines: list[tuple[int, str]], level: int) -> dict[str, int]:
    """Normalised passages of a level with their lengths: single lines, paragraphs, and runs of lines."""
    found: dict[str, int] = {}

    def add(parts: list[str]) -> None:
        passage = _normal(" ".join(parts))
        if passage:
            found[passage] = len(passage)

    run: list[str] = []
    paragraph: list[str] = []
    for own, line in [*lines, (-1, "")]:
        if own == level:
            add([line])
            run.append(line)
            if line.strip():
                paragraph.append(line)
                continue
        add(paragraph)
        paragraph = []
        if own != level:
            add(run)
            run = []
    return found


_PARSED = "conv_id long, turn long, level int, passage long, chars long"


def parsed(messages: DataFrame) -> DataFrame:
    """One row per passage of each message; those of ``level`` 0 are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                rows = []
                for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    lines = parse(text)
                    levels = sorted({level for level, _ in lines})
                    for level in levels:
                        for passage, chars in passages(lines, level).items():
                            value = xxhash.xxh64_intdigest(passage) - (1 << 63)
                            rows.append((conv, turn, level, value, chars))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["conv_id", "turn", "level", "passage", "chars"],
                )

    return messages.mapInArrow(run, _PARSED)


def replies(found: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to``: the earlier message most of the quoted characters come from.

    The lowest quote level with a known passage decides; a tie goes to the later message.
    """
    first = (
        found.where("level = 0")
        .groupBy("conv_id", "passage")
        .agg(F.min("turn").alias("origin"))
    )
    quoted = found.where("level > 0").select("conv_id", "turn", "level", "passage", "chars").distinct()
    votes = (
        quoted.join(first, ["conv_id", "passage"])
        .where(F.col("origin") < F.col("turn"))
        .groupBy("conv_id", "turn", "level", "origin")
        .agg(F.sum("chars").alias("chars"))
    )
    best = F.max_by("origin", F.struct(-F.col("level"), "chars", "origin"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, root, depth`` of the messages that reply to one.

    Every round doubles the links a message looks past, so a chain takes as many rounds as the logarithm of its
    length.
    """
    known = materialize(
        links.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads"
    )
    while True:
        above = known.select(
            "conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more")
        )
        longer = known.join(above, ["conv_id", "root"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("further", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("further").isNotNull().alias("moved"),
        )
        known = materialize(longer, "threads")
        if known.where("moved").isEmpty():
            return known.drop("moved")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations (``conv_id, turn, role, text``) without quotations, each reply behind what it replies to.

    Returns conv_id, position (from 0), turn, role, reply_to, root, depth, quotes (number of quote levels) and text,
    one row per row of ``messages``.  Threads follow each other by the turn of their first message, and turns within
    a thread by number; a message whose quotations match no earlier one starts a thread.  A null text counts as
    empty; a row without conv_id or turn is linked with nothing and comes first; repeated rows stay, next to each
    other; texts of any length are parsed whole; other columns are ignored; an empty table gives no rows.
    """
    texts = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of().alias("text"))
    found = materialize(parsed(texts), "passages")
    links = materialize(replies(found.where("conv_id is not null and turn is not null")), "replies")
    placed = threads(links) if not links.isEmpty() else links.select(
        "conv_id", "turn", F.col("reply_to").alias("root"), F.lit(0).cast("long").alias("depth")
    )
    # The own text depends on the text alone, and the text is the row's: no join puts them together.
    named = _with_own_text(messages)
    joined = (
        named.join(links, ["conv_id", "turn"], "left")
        .join(placed, ["conv_id", "turn"], "left")
        .withColumn("root", F.coalesce("root", "turn"))
        .withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    )
    order = ["conv_id", "root", "turn", "role", "text"]
    numbered = materialize(ordered_ids(joined, order, "place"), "ordered")
    starts = numbered.groupBy(F.col("conv_id").alias("conversation")).agg(F.min("place").alias("start"))
    return numbered.join(starts, F.col("conv_id").eqNullSafe(F.col("conversation"))).select(
        "conv_id", (F.col("place") - F.col("start")).alias("position"), "turn", "role", "reply_to", "root", "depth",
        "quotes", "text",
    )


def _with_own_text(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                lines = [parse(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"),
                        batch.column("turn"),
                        batch.column("role"),
                        pa.array([len({level for level, _ in x if level}) for x in lines], pa.int32()),
                        pa.array([own_text(x) for x in lines], pa.string()),
                    ],
                    names=["conv_id", "turn", "role", "quotes", "text"],
                )

    texts = messages.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        text_of().alias("text"),
    )
    return texts.mapInArrow(run, "conv_id long, turn long, role string, quotes int, text string")
