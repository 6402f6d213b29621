"""Partial sums that travel as one binary per partition and block, and are added level by level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.runtime import materialize

# Partial sums that one task adds.
FAN = 16


def added(parts: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """``keys..., sums``: the sums of the rows of each key.

    ``parts`` has ``keys..., part, sums``: ``sums`` are 8-byte floats as binary, ``part`` numbers the partitions.  A
    task holds about ``fan`` of them, however many partitions there are.
    """
    parts = materialize(parts, "partial-sums")
    count = parts.select("part").distinct().count()
    types = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "part long, sums binary"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        first = table.select([*keys, "part"]).slice(0, 1)
        return first.append_column("sums", pa.array([total.tobytes()], pa.binary()))

    while True:
        count = max(1, -(-count // fan))
        dealt = parts.select(*keys, F.pmod(F.xxhash64("part"), F.lit(count)).alias("part"), "sums")
        merged = dealt.groupBy(*keys, "part").applyInArrow(add, schema)
        if count == 1:
            return merged.drop("part")
        parts = materialize(merged, "partial-sums")
