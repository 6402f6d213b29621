"""URL rules: a blocked Bloom filter of the listed URLs in front of an exact hash join.

A listed entry is a host with a path beginning.  A page can only be matched by keys made of the last labels of
its host and the first characters of its path, in the sizes that occur in the list.  Those keys are probed in a
Bloom filter whose 64-bit blocks are rows of a table; only possible hits reach the exact join, which removes the
false ones.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.runtime import broadcast_if_small

# Listed keys per 64-bit block, and the bits each sets: about one false hit in 200 keys.
KEYS_PER_BLOCK = 4
BITS_PER_KEY = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules(spark: SparkSession, entries: Sequence[tuple[str, str]]) -> DataFrame:
    """A rule table from (verdict, host and path) pairs like ``("block", "example.org/es/")``."""
    split = [(v, *((e.split("/", 1)[0], "/" + e.split("/", 1)[1]) if "/" in e else (e, ""))) for v, e in entries]
    return spark.createDataFrame(split, "rule_verdict string, rule_host string, rule_path string")


def _block_and_mask(host: Column, path: Column, blocks: int) -> tuple[Column, Column]:
    block = F.pmod(F.xxhash64(host, path), F.lit(blocks).cast("long"))
    bits = F.xxhash64(path, host)
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return block, mask


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, word``: the filter, a row per block that is not empty."""
    block, mask = _block_and_mask(F.col("rule_host"), F.col("rule_path"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every page's url by a rule table (``rule_verdict, rule_host, rule_path``).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins (of equally
    long ones the longer host, then block).  A url that no rule fits, a null or malformed one too, has a null rule
    and the verdict ``default``.  Returns page_id, host, path, rule, verdict for every row; repeated rows stay;
    rules with a null or empty host fit nothing; other columns are ignored.
    """
    listed = listed.where("rule_host <> '' and rule_path is not null and rule_verdict is not null").distinct()
    sizes = (
        listed.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))
        .distinct()
        .collect()  # one row per number of labels and path length that occur: bounded by the longest entry
    )
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    keys = [
        F.when(
            (F.size(labels) >= s["labels"]) & (F.length("path") >= s["chars"]),
            F.struct(
                F.array_join(F.slice(labels, -s["labels"], s["labels"]), ".").alias("key_host"),
                F.substring("path", 1, s["chars"]).alias("key_path"),
            ),
        )
        for s in sizes
    ]
    if not keys:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    probes = (
        parsed.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_compact(F.array(*keys))).alias("key"))
        .select("host", "path", "key.*")
    )
    block, mask = _block_and_mask(F.col("key_host"), F.col("key_path"), blocks)
    possible = (
        probes.withColumn("block", block)
        .withColumn("mask", mask)
        .join(broadcast_if_small(bloom_filter(listed, blocks)), "block")
        .where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
    )
    exact = (F.col("key_host") == F.col("rule_host")) & (F.col("key_path") == F.col("rule_path"))
    order = F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block"
    )
    chosen = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    hits = (
        possible.join(broadcast_if_small(listed), exact)
        .groupBy("host", "path")
        .agg(F.max_by(chosen, order).alias("chosen"))
    )
    return parsed.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", "chosen.rule", F.coalesce("chosen.verdict", F.lit(default)).alias("verdict")
    )
