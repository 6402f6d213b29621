"""Toxicity by a weighted lexicon that is learned from labelled rows and matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, and digits and signs that stand
for letters inside a word.  A term is a whole word or the beginning of words.  Its weight is the logarithm of how many
times larger the share of toxic training rows with it is.  A word between two others is counted for one row only, so
copies of one text do not make its words look toxic; a beginning that several different words of a row share is better
evidence than one word.  Exceptions are learned as well: two words with a term in them that are no more frequent in
toxic rows than in others, although the term's other uses are.  A text's weights are summed, hits inside exceptions
left out, set against its length, and turned into a probability by a logistic curve.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.llm.common import bounded, text_of
from hinloom.runtime import materialize

# Labelled rows the model is fitted on at most; which ones is decided by a hash of their ids.
TRAINING_ROWS = 6_000

# A text is toxic from this score on.
THRESHOLD = 0.3

# Lengths of the word beginnings that may become terms: all from 3 to 6, then each a third longer than the one before,
# so that a word of any length has a few and they are together no longer than some times the word.
BEGINNINGS = [3, 4, 5, 6]
while BEGINNINGS[-1] < 1 << 24:
    BEGINNINGS.append(BEGINNINGS[-1] * 4 // 3)

# A term needs a log-likelihood ratio that about one of all terms would reach by chance, plus this, at least so many
# toxic rows, and this much larger a share of them.
MARGIN = 0.0
LEAST_ROWS = 3
LEAST_RATIO = 10.0

# A longer beginning stands for a shorter one that holds hardly more occurrences.
SAME_SHARE = 0.98
TOGETHER_SHARE = 0.95

# What may become a term if its uses in exceptions are left out is this much more frequent in toxic rows with them.
LIKELY_RATIO = 4.0

# Letters of other scripts that look like Latin ones (Cyrillic, Greek, dotless i).
LOOK_ALIKES = {
    **dict(zip("авеёікмнорстухѕјԁԛԝ", "abeeikmhopctyxsjdqw", strict=True)),
    **dict(zip("αβεγικνορτυχωı", "abeyikvoptuxwi", strict=True)),
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOREIGN = re.compile("[" + "".join(LOOK_ALIKES) + "！-～]")
_LATIN = re.compile("[a-z]")
# A run of word characters and signs with one of them that may stand for a letter.
_DISGUISED = re.compile(r"(?<![\w@$!])(?=\w*[0134578@$!])[\w@$!]+")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W_]+")
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TO_LATIN = str.maketrans(LOOK_ALIKES) | _WIDE
_TO_LETTER = str.maketrans(SUBSTITUTES)


def _latin(match: re.Match) -> str:
    # Only a word that mixes scripts is disguised; a word all in its own script stays.
    word = match.group()
    return word.translate(_TO_LATIN) if _LATIN.search(word.translate(_WIDE)) else word


def _letters(match: re.Match) -> str:
    # A number stays a number, and an exclamation mark at the end of a word one.
    token = match.group()
    word = token.rstrip("!")
    return word.translate(_TO_LETTER) + token[len(word) :] if _LETTER.search(word) else token


def fold(text: str) -> str:
    """Folded words of a text, each between single blanks."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = _WORD.sub(_latin, text)
    text = _DISGUISED.sub(_letters, text)
    return f" {' '.join(_WORD.findall(text))} "


@dataclass
class Lexicon:
    """Terms with their weights, exception phrases, and the curve from summed weights to a probability.

    A term starts with a blank, and ends with one where it is a whole word.
    """

    terms: dict[str, float]
    exceptions: Sequence[str] = ()
    curve: tuple[float, float, float] = (-4.0, 4.0, 4.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}  # built by each worker

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                phrase = fold(phrase)
                self._automaton.add_word(phrase, (len(phrase), None))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> tuple[float, int]:
        """Summed weights, the heaviest of each word, and the number of words of a text."""
        folded = fold(text)
        words = folded.count(" ") - 1 if folded.strip() else 0
        if not self.terms or not words:
            return 0.0, words
        heaviest: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        if harmless:
            heaviest = {
                at: w for at, w in heaviest.items() if not any(start <= at < end for start, end in harmless)
            }
        return sum(heaviest.values()), words

    def score(self, text: str) -> float:
        weight, words = self.hits(text)
        return probability(np.array([[weight, words]], float), self.curve)[0]


def _features(sums: np.ndarray) -> np.ndarray:
    weight, words = sums[:, 0], sums[:, 1]
    return np.stack([np.ones(len(sums)), np.log1p(weight), 10 * weight / (words + 20)], 1)


def probability(sums: np.ndarray, curve: Sequence[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(sums) @ np.array(curve), -30, 30)))


def fit_curve(sums: np.ndarray, toxic: np.ndarray, penalty: float = 0.05) -> tuple[float, float, float]:
    """Logistic curve over (summed weight, words) by Newton's method; the penalty keeps separable data finite."""
    features = _features(sums)
    curve = np.zeros(3)
    ridge = penalty * np.array([0.1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))
        gradient = features.T @ (p - toxic) + ridge * curve
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        curve -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(c) for c in curve)


# --- learning ----------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: ``crc32`` of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``rows`` labelled rows that are not held out, by a hash of the id."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))  # toxic, if any of several labels says so
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return materialize(texts.join(F.broadcast(known), "doc_id"), "training-rows")


def beginnings(word: str) -> list[str]:
    """Terms that a word is a use of: itself between blanks, and its beginnings behind one."""
    lengths = itertools.takewhile(lambda n: n < len(word), BEGINNINGS)
    return [f" {word} ", *(f" {word[:n]}" for n in lengths)]


def _words(training: DataFrame) -> DataFrame:
    """``word, doc_id, toxic``: each word of a row, if the row is the first with it between the same words.

    The rows of a document come together, so that what is counted per document needs no further shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    words = fold(text.as_py()).split()
                    around = zip(["", *words], words, [*words[1:], ""], strict=False)
                    seen = {(word, xxhash.xxh64_intdigest(f"{before} {after}") - (1 << 63)) for before, word, after in around}
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([w for w, _ in seen], pa.string()),
                            pa.array([b for _, b in seen], pa.int64()),
                            pa.array([doc] * len(seen), pa.int64()),
                        ],
                        names=["word", "between", "doc_id"],
                    )

    found = training.select("doc_id", "text").mapInArrow(run, "word string, between long, doc_id long")
    owned = found.groupBy("word", "between").agg(F.min("doc_id").alias("doc_id")).select("word", "doc_id")
    return _with_label(owned.repartition("doc_id").distinct(), training)


def _with_label(rows: DataFrame, training: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(training.select("doc_id", "toxic").distinct()), "doc_id")  # `TRAINING_ROWS` at most


def _terms(words: DataFrame) -> DataFrame:
    """A row per term that a word is a use of, as `beginnings` gives them."""
    word = F.col("word")
    lengths = F.filter(F.array(*map(F.lit, BEGINNINGS)), lambda n: n < F.length(word))
    parts = F.transform(lengths, lambda n: F.concat(F.lit(" "), F.substring(word, F.lit(1), n)))
    whole = F.array(F.concat(F.lit(" "), word, F.lit(" ")))
    return words.select("word", "doc_id", "toxic", F.explode(F.concat(whole, parts)).alias("term"))


def _uses(training: DataFrame, few: frozenset[str]) -> DataFrame:
    """``term, word, left, right, doc_id, toxic``: uses of a few terms with the words before and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    words = fold(text.as_py()).split()
                    around = zip(["", *words], words, [*words[1:], ""], strict=False)
                    uses = [(t, w, f"{b} {w}", f"{w} {a}") for b, w, a in set(around) for t in beginnings(w) if t in few]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array([use[k] for use in uses], pa.string()) for k in range(4)],
                            pa.array([doc] * len(uses), pa.int64()),
                        ],
                        names=["term", "word", "left", "right", "doc_id"],
                    )

    columns = "term string, word string, left string, right string, doc_id long"
    found = training.select("doc_id", "text").mapInArrow(run, columns)
    return _with_label(found.groupBy("term", "word", "left", "right").agg(F.min("doc_id").alias("doc_id")), training)


def counted(uses: DataFrame, key: str = "term") -> DataFrame:
    """Toxic and other rows of each term: ``a`` and ``b``, and as evidence ``more_a`` and ``more_b``.

    A row with n different words of a term is evidence of log2(1 + n) rows.  ``uses`` has a word of a row and term once.
    """
    per_row = uses.groupBy(key, "doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"))
    is_toxic = F.col("toxic") == 1
    more = F.log2(1 + F.col("n"))
    return per_row.groupBy(key).agg(
        F.count_if(is_toxic).alias("a"),
        F.count_if(~is_toxic).alias("b"),
        F.round(F.sum(F.when(is_toxic, more).otherwise(0.0)), 6).alias("more_a"),
        F.round(F.sum(F.when(is_toxic, 0.0).otherwise(more)), 6).alias("more_b"),
    )


def _evidence(a: np.ndarray, b: np.ndarray, total_a: float, total_b: float) -> np.ndarray:
    """Log-likelihood ratio of counts a and b against equal shares."""
    share = total_a / (total_a + total_b)
    expected_a, expected_b = (a + b) * share, (a + b) * (1 - share)
    part = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (part(a, expected_a) + part(b, expected_b))


def chosen_terms(
    counts: dict[str, tuple[int, int, float, float]], total_a: float, total_b: float, least_evidence: float
) -> dict[str, float]:
    """Weights of the terms with evidence, without those another chosen one stands for.

    ``counts`` has the numbers of `counted`; a term ends with a blank where it is a whole word.
    """
    if not counts:
        return {}
    a, b, more_a, more_b = np.array(list(counts.values()), float).T
    ratio = ((more_a + 0.5) / (total_a + 1)) / ((more_b + 0.5) / (total_b + 1))
    good = (a >= LEAST_ROWS) & (_evidence(more_a, more_b, total_a, total_b) >= least_evidence) & (ratio >= LEAST_RATIO)
    weight = {t: math.log(r) for t, r, g in zip(counts, ratio, good, strict=True) if g}
    # A beginning gives way to a longer one, or a word, that has nearly all its rows.
    heir: dict[str, int] = {}
    for term in weight:
        for n in range(2, len(term)):
            if term[:n] in weight:
                heir[term[:n]] = max(heir.get(term[:n], 0), counts[term][0])
    weight = {t: w for t, w in weight.items() if heir.get(t, 0) < SAME_SHARE * counts[t][0]}
    # One that also begins harmless words gives way to heavier terms that have nearly all its toxic rows together.
    heavier: dict[str, int] = {}
    for term in weight:
        for n in range(2, len(term)):
            if weight.get(term[:n], math.inf) + 0.5 <= weight[term]:
                heavier[term[:n]] = heavier.get(term[:n], 0) + counts[term][0]
    weight = {t: w for t, w in weight.items() if heavier.get(t, 0) < TOGETHER_SHARE * counts[t][0]}
    # What a remaining beginning covers needs no term of its own unless it weighs clearly more.
    for term in sorted(weight, key=len, reverse=True):
        cover = [weight[term[:n]] for n in range(2, len(term)) if term[:n] in weight]
        if cover and weight[term] < max(cover) + 1:
            del weight[term]
    return weight


def learned_exceptions(uses: DataFrame, terms: dict[str, tuple], least_evidence: float) -> list[str]:
    """Pairs of words with a term that toxic rows do not have more often than others, unlike the term's other uses.

    They come from the rows of a few terms, are on `LEAST_ROWS` other rows at least, and pass the evidence test, so
    they fit the driver.
    """
    sides = [uses.select("term", "doc_id", "toxic", "word", F.col(side).alias("phrase")) for side in ("left", "right")]
    keyed = sides[0].union(sides[1]).select(F.concat_ws("\n", "term", "phrase").alias("key"), "word", "doc_id", "toxic")
    found = counted(keyed.distinct(), "key").where(F.col("b") >= LEAST_ROWS)
    out = set()
    for r in found.where(F.col("a") <= F.col("b")).select("key", "a", "b").collect():
        term, phrase = r["key"].split("\n")
        other_a, other_b = terms[term][0] - r["a"], terms[term][1] - r["b"]
        evidence = _evidence(np.array([r["a"]], float), np.array([r["b"]], float), other_a + 0.5, other_b + 0.5)[0]
        # Of the term's other uses, more are toxic.
        if evidence >= least_evidence and r["a"] * (other_b + 0.5) < r["b"] * (other_a + 0.5) and len(phrase.split()) == 2:
            out.add(phrase)
    return sorted(out)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learn a lexicon from ``labels`` (``doc_id, toxic``) of ``docs``; no row that is held out is looked at.

    ``exceptions`` are phrases known to be harmless; others are learned.  Words of any length are learned from.
    Terms are counted by Spark; what comes to the driver are the few that toxic rows have more often, and two sums
    per training row.  Without labels of both kinds the lexicon is empty.
    """
    training = training_rows(docs, labels, rows)
    kinds = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    total_a, total_b = float(kinds.get(1, 0)), float(kinds.get(0, 0))
    if not total_a or not total_b:
        return Lexicon({}, tuple(exceptions))
    frequent = materialize(counted(_terms(_words(training))), "training-terms").where(F.col("a") + F.col("b") >= LEAST_ROWS)
    least_evidence = 2 * math.log(max(2, frequent.count())) + MARGIN
    likely = frequent.where((F.col("a") >= LEAST_ROWS) & (F.col("a") * total_b >= F.col("b") * total_a * LIKELY_RATIO))
    known = {r["term"]: (r["a"], r["b"], r["more_a"], r["more_b"]) for r in likely.collect()}
    mixes = np.array(list(known.values()), float).reshape(-1, 4).T
    enough = _evidence(mixes[2], mixes[3], total_a, total_b) >= least_evidence
    few = {t: n for (t, n), good in zip(known.items(), enough, strict=True) if good}
    uses = materialize(_uses(training, frozenset(few)), "term-uses")
    exceptions = sorted({*exceptions, *learned_exceptions(uses, few, least_evidence)})
    if exceptions:
        harmless = [fold(phrase).strip() for phrase in exceptions]
        uses = uses.where(~F.col("left").isin(harmless) & ~F.col("right").isin(harmless))
    again = counted(uses.select("term", "word", "doc_id", "toxic").distinct())
    counts = {r["term"]: (r["a"], r["b"], r["more_a"], r["more_b"]) for r in again.collect()}
    lexicon = Lexicon(chosen_terms(counts, total_a, total_b, least_evidence), tuple(exceptions))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.hits(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in found], pa.float64()),
                    pa.array([float(n) for _, n in found], pa.float64()),
                    batch.column("toxic"),
                ],
                names=["weight", "words", "toxic"],
            )

    fitted = np.array(training.mapInArrow(sums, "weight double, words double, toxic int").collect(), float)
    lexicon.curve = fit_curve(fitted[:, :2], fitted[:, 2])
    return lexicon


# --- use ---------------------------------------------------------------------------


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text decides.

    A null text counts as empty and has the score of a text without hits; texts are taken whole; repeated rows are
    scored each; a null id is not held out; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                sums = np.array([shared.value.hits(t.as_py()) for t in batch.column("text")], float).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(probability(sums, shared.value.curve))],
                    names=["doc_id", "score"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                texts = batch.column(at)
                sums = np.array([shared.value.hits(t.as_py() or "") for t in texts], float).reshape(-1, 2)
                yield batch.filter(pa.array(probability(sums, shared.value.curve) < threshold))

    return docs.mapInArrow(run, docs.schema)
