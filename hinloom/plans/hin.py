"""Building a typed network from entity and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.operators.dictionary import labelled, misses, resolve_edges
from hinloom.runtime import ordered_ids


@dataclass(frozen=True)
class Entity:
    """One vertex type: a table with an id and a name, and optional labels."""

    table: DataFrame
    id: str
    name: str
    labels: DataFrame | None = None
    label_id: str = "id"
    label: str = "class"


@dataclass(frozen=True)
class Relation:
    """One edge type between two vertex types."""

    table: DataFrame
    src_type: str
    src: str
    dst_type: str
    dst: str
    name: str


@dataclass(frozen=True)
class Network:
    vertices: DataFrame
    edges: DataFrame
    unresolved: DataFrame

    def counts(self) -> DataFrame:
        """Vertices per type and edges per relation."""
        nodes = self.vertices.groupBy(F.lit("vertex").alias("kind"), F.col("type").alias("name"))
        links = self.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name"))
        return nodes.agg(F.count(F.lit(1)).alias("n")).unionByName(
            links.agg(F.count(F.lit(1)).alias("n"))
        )


def build(entities: Mapping[str, Entity], relations: Sequence[Relation]) -> Network:
    """``vertices(vid, type, id, label, name)`` and ``edges(src, dst, rel)``.

    Vertex ids are the positions of ``(type, id)`` in sort order.  A vertex has one row, however often its id or a
    label of it is given; the smallest name and label count.  Edges with an end outside the entity tables are kept
    apart in ``unresolved``.
    """
    parts = []
    for kind, e in entities.items():
        rows = e.table.select(
            F.lit(kind).alias("type"),
            F.col(e.id).cast("string").alias("id"),
            F.col(e.name).alias("name"),
        )
        if e.labels is None:
            rows = rows.withColumn("label", F.lit("L00"))
        else:
            known = e.labels.select(F.col(e.label_id).cast("string").alias("_lid"), F.col(e.label).alias("_class"))
            rows = labelled(rows, "id", known, "_lid", "_class")
        parts.append(rows.select("type", "id", "label", "name"))
    given = reduce(DataFrame.unionByName, parts)
    union = given.groupBy("type", "id").agg(F.min("label").alias("label"), F.min("name").alias("name"))
    vertices = ordered_ids(union, ["type", "id"], "vid").select("vid", "type", "id", "label", "name")

    resolved, unresolved = [], []
    for r in relations:
        pairs = r.table.select(
            F.col(r.src).cast("string").alias("src"),
            F.col(r.dst).cast("string").alias("dst"),
            F.lit(r.name).alias("rel"),
        )
        resolved.append(resolve_edges(pairs, r.src_type, r.dst_type, vertices))
        for end, kind in (("src", r.src_type), ("dst", r.dst_type)):
            ids = vertices.where(F.col("type") == kind)
            unresolved.append(
                misses(pairs, end, ids, "id").select(F.lit(end).alias("end"), "src", "dst", "rel")
            )
    return Network(
        vertices, reduce(DataFrame.unionByName, resolved), reduce(DataFrame.unionByName, unresolved)
    )
