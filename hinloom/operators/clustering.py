"""Centre-based clustering, mixtures and topics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import LDA, GaussianMixture, GaussianMixtureModel, KMeans, KMeansModel, LDAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.operators.dense import multiply_local, rows_of
from hinloom.operators.ordering import top_k_per_key
from hinloom.operators.packed import added
from hinloom.runtime import double_array


# Values of a batch handled at once, so wide rows do not multiply its memory.
_CHUNK_VALUES = 1 << 22


def _nearest(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, nearest centre, squared distance)`` in chunks of rows.

    One matrix product ranks the centres; the distance to the chosen one is
    then taken from the differences, which keeps its digits.
    """
    middle = centres.mean(axis=0)
    shifted = centres - middle
    lengths = np.einsum("ij,ij->i", shifted, shifted)
    step = max(1, _CHUNK_VALUES // max(1, x.shape[1]))
    for start in range(0, len(x), step):
        rows = x[start : start + step]
        best = (lengths - 2.0 * ((rows - middle) @ shifted.T)).argmin(axis=1)
        gap = rows - centres[best]
        yield rows, best, np.einsum("ij,ij->i", gap, gap)


def assign(df: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``cluster`` and ``sq_distance``; the lowest index wins a tie."""
    grid = np.asarray(centres, dtype=float)
    kept = df.withColumn("_x", double_array(features))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, best, d = map(np.concatenate, zip(*_nearest(rows_of(batch, "_x"), grid)))
            table = pa.Table.from_batches([batch]).drop_columns(["_x"])
            table = table.append_column("cluster", pa.array(best.astype("int32")))
            table = table.append_column("sq_distance", pa.array(d))
            yield from table.to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return kept.mapInArrow(nearest, f"{fields}, cluster int, sq_distance double")


def run_sums(df: DataFrame, features: str, runs: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """``(run, cluster, n, cost, sums)`` of the rows nearest to each centre of each run, in one pass.

    A partition sends one packed table of sums; the rows themselves stay put.
    """
    grids = [np.asarray(centres, dtype=float) for centres in runs]
    width = grids[0].shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((len(grid), width + 2)) for grid in grids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = rows_of(batch, "x")
            for grid, table in zip(grids, tables, strict=True):
                for rows, best, d in _nearest(x, grid):
                    table[:, 0] += np.bincount(best, minlength=len(grid))
                    table[:, 1] += np.bincount(best, weights=d, minlength=len(grid))
                    members = np.zeros((len(rows), len(grid)))
                    members[np.arange(len(rows)), best] = 1.0
                    table[:, 2:] += members.T @ rows
        packed = np.vstack(tables).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed], pa.binary())],
            names=["part", "sums"],
        )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = np.repeat(np.arange(len(grids)), [len(g) for g in grids])
        cluster = np.concatenate([np.arange(len(g)) for g in grids])
        for batch in batches:
            for data in batch.column("sums"):
                table = np.frombuffer(data.as_py()).reshape(-1, width + 2)
                hit = np.flatnonzero(table[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(run[hit], pa.int32()),
                        pa.array(cluster[hit], pa.int32()),
                        pa.array(table[hit, 0].astype("int64")),
                        pa.array(table[hit, 1]),
                        pa.array(table[hit, 2:].tolist(), pa.list_(pa.float64())),
                    ],
                    names=["run", "cluster", "n", "cost", "sums"],
                )

    parts = df.select(double_array(features).alias("x")).mapInArrow(partial, "part long, sums binary")
    return added(parts, []).mapInArrow(unpack, "run int, cluster int, n long, cost double, sums array<double>")


def cluster_sums(df: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``(cluster, n, cost, sums)`` of the rows nearest to each centre."""
    return run_sums(df, features, [centres]).drop("run")


def lloyd_runs(
    df: DataFrame,
    features: str,
    starts: Sequence[Sequence[Sequence[float]]],
    iterations: int = 20,
    tolerance: float = 1e-4,
) -> tuple[list[np.ndarray], list[float], int]:
    """Centres and costs of Lloyd runs from given centres, and the number of passes over the rows.

    All runs that still move share a pass; a run whose centres all move by no more than ``tolerance`` drops out.  An
    empty centre keeps its place.  A cost is that of the centres before the run's last step, or of the last pass.
    """
    centres = [np.asarray(start, dtype=float) for start in starts]
    costs = [float("nan")] * len(centres)
    moving = list(range(len(centres)))
    passes = 0
    while moving and passes < iterations:
        rows = run_sums(df, features, [centres[r] for r in moving]).collect()  # the centres of the runs
        passes += 1
        still = []
        for at, run in enumerate(moving):
            own = [r for r in rows if r["run"] == at]
            new = centres[run].copy()
            for r in own:
                new[r["cluster"]] = np.array(r["sums"]) / r["n"]
            costs[run] = sum(r["cost"] for r in own)
            if ((new - centres[run]) ** 2).sum(1).max() > tolerance * tolerance:
                still.append(run)
            centres[run] = new
        moving = still
    return centres, costs, passes


def lloyd_step(df: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``(cluster, n, centre)`` after one step; an empty centre keeps its place."""
    spark = df.sparkSession
    start = spark.createDataFrame(
        [(c, [float(v) for v in centre]) for c, centre in enumerate(centres)], "cluster int, _old array<double>"
    )
    sums = cluster_sums(df, features, centres).select("cluster", "n", "sums")
    mean = F.transform("sums", lambda v: v / F.col("n"))
    return start.join(sums, "cluster", "left").select(
        "cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(mean, "_old").alias("centre")
    )


def within_cost(df: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """One row: the sum of squared distances to the nearest centre."""
    return cluster_sums(df, features, centres).agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(double_array(features)))


def k_means(
    df: DataFrame,
    features: str,
    k: int = 2,
    iterations: int = 20,
    runs: int = 1,
    init: str = "k-means||",
    init_steps: int = 5,
    tolerance: float = 1e-4,
    seed: int = 42,
) -> KMeansModel:
    """The run of lowest cost.  Persist ``df``: every run passes over it."""
    best = None
    rows = _vectors(df, features).select("_features")
    for run in range(runs):
        model = KMeans(
            featuresCol="_features", k=k, maxIter=iterations, initMode=init, initSteps=init_steps,
            tol=tolerance, seed=seed + run,
        ).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def centres_of(model: KMeansModel) -> list[list[float]]:
    return [[float(v) for v in c] for c in model.clusterCenters()]


def gaussian_mixture(
    df: DataFrame, features: str, k: int = 2, tolerance: float = 0.01, iterations: int = 100, seed: int = 42
) -> GaussianMixtureModel:
    return GaussianMixture(featuresCol="_features", k=k, tol=tolerance, maxIter=iterations, seed=seed).fit(
        _vectors(df, features).select("_features")
    )


def mixture_step(
    df: DataFrame, features: str, weights: Sequence[float], means: Sequence, covariances: Sequence
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One EM step from given parameters: ``(weights, means, covariances)`` after it, and the log likelihood before it.

    A partition sends, packed, each component's sum of shares, and its weighted sums and products of rows less the old
    mean, so that a small variance far from zero keeps its digits.
    """
    w, m = np.asarray(weights, dtype=float), np.asarray(means, dtype=float)
    k, width = m.shape
    forms = []
    for covariance in covariances:
        values, basis = np.linalg.eigh(np.asarray(covariance, dtype=float))
        kept = values > np.finfo(float).eps * max(values.max(), 0.0) * width
        if not kept.any():
            raise ValueError("a covariance has no non-zero variance")
        constant = -0.5 * (width * math.log(2 * math.pi) + float(np.log(values[kept]).sum()))
        forms.append((basis[:, kept] / np.sqrt(values[kept]), constant))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood, shares = 0.0, np.zeros(k)
        sums, products = np.zeros((k, width)), np.zeros((k, width, width))
        for batch in batches:
            step = max(1, _CHUNK_VALUES // max(1, width * k))
            for start in range(0, batch.num_rows, step):
                x = rows_of(batch.slice(start, step), "x")
                logs = np.stack(
                    [math.log(w[c]) + forms[c][1] - 0.5 * (((x - m[c]) @ forms[c][0]) ** 2).sum(1) for c in range(k)]
                )
                top = logs.max(0)
                total = top + np.log(np.exp(logs - top).sum(0))
                likelihood += float(total.sum())
                share = np.exp(logs - total)
                shares += share.sum(1)
                for c in range(k):
                    gap = x - m[c]
                    sums[c] += share[c] @ gap
                    products[c] += (gap * share[c][:, None]).T @ gap
        packed = np.concatenate([[likelihood], shares, sums.ravel(), products.ravel()]).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed], pa.binary())],
            names=["part", "sums"],
        )

    parts = df.select(double_array(features).alias("x")).mapInArrow(partial, "part long, sums binary")
    found = added(parts, []).first()
    if found is None:
        return w, m, np.asarray(covariances, dtype=float), 0.0
    flat = np.frombuffer(found["sums"])
    shares, sums = flat[1 : k + 1], flat[k + 1 : k + 1 + k * width].reshape(k, width)
    products = flat[k + 1 + k * width :].reshape(k, width, width)
    moved = sums / shares[:, None]
    spread = products / shares[:, None, None] - moved[:, :, None] * moved[:, None, :]
    return shares / shares.sum(), m + moved, spread, float(flat[0])


def fit_mixture(
    df: DataFrame,
    features: str,
    weights: Sequence[float],
    means: Sequence,
    covariances: Sequence,
    tolerance: float = 0.01,
    iterations: int = 100,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """EM from a start model until the log likelihood gains no more than ``tolerance``; persist or write ``df``."""
    history: list[float] = []
    for _ in range(iterations):
        weights, means, covariances, likelihood = mixture_step(df, features, weights, means, covariances)
        history.append(likelihood)
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance:
            break
    return np.asarray(weights), np.asarray(means), np.asarray(covariances), history


def predict_mixture(df: DataFrame, model: GaussianMixtureModel, features: str) -> DataFrame:
    """Add the hard ``cluster`` and the soft ``probabilities``."""
    scored = model.transform(_vectors(df, features))
    return scored.select(
        *df.columns, F.col("prediction").alias("cluster"), vector_to_array("probability").alias("probabilities")
    )


def gaussian_logpdf(
    df: DataFrame, features: str, mean: Sequence[float], covariance: Sequence[Sequence[float]], name: str = "logpdf"
) -> DataFrame:
    """Add the log density of a normal with the given mean and covariance.

    Directions of (numerically) zero variance are left out, as a
    pseudo-inverse and pseudo-determinant do; all zero raises.
    """
    values, basis = np.linalg.eigh(np.asarray(covariance, dtype=float))
    kept = values > np.finfo(float).eps * max(values.max(), 0.0) * len(values)
    if not kept.any():
        raise ValueError("the covariance has no non-zero variance")
    whitening = basis[:, kept] / np.sqrt(values[kept])
    constant = -0.5 * (len(mean) * math.log(2 * math.pi) + float(np.log(values[kept]).sum()))
    centred = F.zip_with(double_array(features), vectors.array_of(mean), lambda x, m: x - m)
    white = multiply_local(df.withColumn("_centred", centred), "_centred", whitening.tolist(), "_white")
    squares = vectors.total(F.transform("_white", lambda v: v * v))
    return white.withColumn(name, F.lit(constant) - squares * 0.5).drop("_centred", "_white")


def topics(
    docs: DataFrame,
    counts: str,
    k: int = 10,
    iterations: int = 20,
    optimizer: str = "em",
    offset: float = 1024.0,
    decay: float = 0.51,
    batch: float = 0.05,
    seed: int = 42,
) -> LDAModel:
    """Latent topics of document-term count vectors; optimizer em or online."""
    return LDA(
        featuresCol=counts, k=k, maxIter=iterations, optimizer=optimizer, learningOffset=offset,
        learningDecay=decay, subsamplingRate=batch, seed=seed,
    ).fit(docs)


def top_terms(model: LDAModel, n: int) -> DataFrame:
    """``(topic, rank, term, weight)``."""
    described = model.describeTopics(n)
    return described.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")
    ).select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.termIndices").alias("term"), F.col("t.termWeights").alias("weight"))


def topic_mix(model: LDAModel, docs: DataFrame, doc: str) -> DataFrame:
    """``(doc, topic, weight)``."""
    mixed = model.transform(docs).select(doc, vector_to_array("topicDistribution").alias("_m"))
    return mixed.select(doc, F.posexplode("_m").alias("topic", "weight"))


def top_documents(mix: DataFrame, doc: str, n: int) -> DataFrame:
    """The documents with the largest share of each topic."""
    return top_k_per_key(mix, ["topic"], [F.desc("weight"), F.col(doc)], n)


def top_topics(mix: DataFrame, doc: str, n: int) -> DataFrame:
    return top_k_per_key(mix, [doc], [F.desc("weight"), F.col("topic")], n)


# Documents whose words are held at once.
_QUALITY_ROWS = 512


def _digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function of positive numbers: recurrence up to 10, then the asymptotic series."""
    x, below = np.array(x, dtype=float), 0.0
    for _ in range(10):
        small = x < 10
        below = below + np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    s = 1 / (x * x)
    series = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132)))))
    return np.log(x) - 0.5 / x - series - below


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, np.ravel(x)), float, np.size(x)).reshape(np.shape(x))


def topic_quality(model: LDAModel, docs: DataFrame) -> DataFrame:
    """One row: bounds on log likelihood and log perplexity.

    The same bound as the model's own, from one inference per document: a document's topic counts are its mix times the
    sum of its words and the prior.  The terms' expected logarithms are taken once, and not once per document.
    """
    spark, counts = docs.sparkSession, model.getFeaturesCol()
    alpha, topics = model.estimatedDocConcentration().toArray(), model.topicsMatrix().toArray()
    vocabulary, k = topics.shape
    default = 1.0 / k if model.getOptimizer() == "online" else 1.1
    eta = model.getTopicConcentration() if model.isDefined(model.topicConcentration) else default
    log_terms = _digamma(topics) - _digamma(topics.sum(0))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in (large.slice(start, _QUALITY_ROWS) for start in range(0, large.num_rows, _QUALITY_ROWS)):
                mix, slots, values = (batch.column(c) for c in range(3))
                flat, doc = values.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(slots.offsets.to_numpy()))
                words = np.bincount(doc, flat, batch.num_rows)[:, None]
                # Without a word the mix is zero and the bound as well.
                gamma = np.where(words > 0, mix.flatten().to_numpy().reshape(-1, k) * (words + alpha.sum()), alpha)
                log_mix = _digamma(gamma) - _digamma(gamma.sum(1))[:, None]
                bound = ((alpha - gamma) * log_mix + _lgamma(gamma) - _lgamma(alpha)).sum()
                bound += (math.lgamma(alpha.sum()) - _lgamma(gamma.sum(1))).sum()
                logs = log_mix[doc] + log_terms[slots.flatten().to_numpy()]
                top = logs.max(1)
                bound += (flat * (top + np.log(np.exp(logs - top[:, None]).sum(1)))).sum()
                yield pa.RecordBatch.from_arrays([pa.array([bound]), pa.array([words.sum()])], names=["bound", "words"])

    cells = F.unwrap_udt(counts)
    # A dense vector has no slots.
    slots = F.coalesce(cells["indices"], F.sequence(F.lit(0), F.size(cells["values"]) - 1))
    mixed = model.transform(docs).where(F.size(cells["values"]) > 0)
    rows = mixed.select(vector_to_array("topicDistribution").alias("mix"), slots.alias("slots"), cells["values"].alias("values"))
    found = rows.mapInArrow(bounds, "bound double, words double").agg(F.sum("bound"), F.sum("words")).first()
    of_topics = float(((eta - topics) * log_terms + _lgamma(topics) - math.lgamma(eta)).sum())
    of_topics += float((math.lgamma(eta * vocabulary) - _lgamma(topics.sum(0))).sum())
    likelihood = (found[0] or 0.0) + of_topics
    values = [(likelihood, -likelihood / found[1] if found[1] else float("nan"))]
    return spark.createDataFrame(values, "log_likelihood double, log_perplexity double")
