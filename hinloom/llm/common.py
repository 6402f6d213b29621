"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, which is `\s` of the tokenizers' pattern.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# A position after a non-space character and before white space.  Every token of the pattern that holds the
# character on the left ends there, and what follows depends on the text on the right alone.
SAFE_CUT = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")

# A run of white space with the run of other characters behind it: the text between two safe cuts.
UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Map record batches; a batch of long texts is cut so that no more than some MB are handled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                yield function(part)

    return df.mapInArrow(run, schema)


BATCH_BYTES = 8 << 20


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into slices of about `BATCH_BYTES`, a row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Cut a text at safe cuts into pieces of ``size`` characters or a little more."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
