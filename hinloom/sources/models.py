"""Saving and loading models that are tables.

Estimators of ``pyspark.ml`` save themselves; `save_fitted` and `load_fitted`
only name that.  A table model is a folder of parquet tables and one JSON line
with its class, version and parameters, checked when it is loaded.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = "1.0"


def save_tables(
    spark: SparkSession, path: str, kind: str, tables: Mapping[str, DataFrame], parameters: Mapping[str, Any] | None = None
) -> None:
    """Data first, metadata last: a folder with metadata is complete."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{name}")
    metadata = {"class": kind, "version": FORMAT_VERSION, "tables": sorted(tables), "parameters": dict(parameters or {})}
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def load_tables(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """``(tables, parameters)``; another class or version raises."""
    metadata = load_metadata(spark, path)
    if metadata["class"] != kind:
        raise ValueError(f"{path} holds a {metadata['class']}, not a {kind}")
    if metadata["version"] != FORMAT_VERSION:
        raise ValueError(f"{path} has version {metadata['version']}, expected {FORMAT_VERSION}")
    tables = {name: spark.read.parquet(f"{path}/data/{name}") for name in metadata["tables"]}
    return tables, metadata["parameters"]


def save_fitted(model, path: str) -> None:
    model.write().save(path)


def load_fitted(model_class, path: str):
    return model_class.load(path)


def save_naive_bayes(model, path: str) -> None:
    spark = model.priors.sparkSession
    save_tables(spark, path, "naive_bayes", {"priors": model.priors, "likelihoods": model.likelihoods}, {"kind": model.kind})


def load_naive_bayes(spark: SparkSession, path: str):
    from hinloom.operators.bayes import NaiveBayesModel

    tables, parameters = load_tables(spark, path, "naive_bayes")
    return NaiveBayesModel(parameters["kind"], tables["priors"], tables["likelihoods"])


def save_rank_state(state, path: str) -> None:
    """Ranks and weights of a class ranking."""
    spark = state.ranks.sparkSession
    save_tables(
        spark,
        path,
        "rankclass",
        {"initial": state.initial, "ranks": state.ranks, "relations": state.relations},
        {"classes": state.classes, "types": state.types, "round": state.round},
    )


def load_rank_state(spark: SparkSession, path: str):
    from hinloom.plans.rankclass import Lanes, State, arc_table

    tables, p = load_tables(spark, path, "rankclass")
    lanes = Lanes.of(tables["relations"])
    arcs = arc_table(tables["relations"], lanes, p["classes"])
    return State(p["classes"], p["types"], tables["initial"], tables["ranks"], arcs, lanes, p["round"])
