"""Toxicity: a linear classifier that may not care which group a sentence names.

Features of a text are its distinct words and their prefixes of 4 to 7 letters.
Training picks the features that tell the labels apart, then fits a logistic
regression by Newton's method on

    log loss + ridge * |w|^2 + fairness * sum over pairs of (z(sentence) - z(counterfactual))^2

over pairs of labelled sentences. A sentence that names a term of an identity
group is paired with itself naming each other term of the group; one sentence of
every labelled text is paired with itself naming a term in addition, for every
term. All terms have features of their own, whether or not the sample holds
them. The penalty drives both kinds of score change to zero: neither the group
that a sentence names nor that it names one counts for or against it.

Everything that grows with the sample's texts stays on executors: features are
counted there, and the driver gets the counts of the best, one row of bits per
labelled document (``most`` of each label) and the distinct differences that
pairs make. Scoring streams whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .staging import stage
from .training import fold, labelled_sample, scored_rows

PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
#: Longer stretches without an end mark are cut.
SENTENCE_WORDS = 40
#: Terms of a group are swapped with each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "transgender"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def word_features(word: str) -> list[str]:
    return [f"w {word}", *[f"{n} {word[:n]}" for n in PREFIXES if len(word) > n]]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def sentences_of(text: str | None) -> list[list[str]]:
    out = []
    for part in SENTENCE_END.split((text or "").lower()):
        words = WORD.findall(part)
        out.extend(words[k : k + SENTENCE_WORDS] for k in range(0, len(words), SENTENCE_WORDS))
    return out


def features_of(words) -> set[str]:
    return {f for w in words for f in word_features(w)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    @property
    def constant(self) -> bool:
        """Whether all texts score alike, as without labels of both kinds: the score then says nothing about a text."""
        return not self.weights

    def scorer(self):
        """A function from texts to scores that remembers which features words have."""
        memory: dict[str, tuple[str, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hits: set[str] = set()
            for w in words_of(text):
                own = memory.get(w)
                if own is None:
                    if len(memory) > 300_000:
                        memory.clear()
                    own = memory[w] = tuple(f for f in word_features(w) if f in weights)
                hits.update(own)
            # Summed in one order, so that equal texts get equal scores.
            z = self.bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def counterfactuals(text: str | None, groups) -> Iterator[tuple[set[str], set[str]]]:
    """Pairs of word sets that should score alike: a sentence, and the same naming another term or one term more."""
    sentences = [set(s) for s in sentences_of(text)]
    for sentence in sentences:
        for group in groups:
            for term in sentence.intersection(group):
                yield from ((sentence, (sentence - {term}) | {other}) for other in group if other not in sentence)
    if sentences:
        # Any one will do; which, depends on the text alone.
        sentence = sentences[xxhash.xxh3_64_intdigest(text or "") % len(sentences)]
        yield from ((sentence, sentence | {term}) for group in groups for term in group if term not in sentence)


def difference(pair: tuple[set[str], set[str]], column: dict[str, int]) -> tuple[int, ...]:
    """The features in which a pair differs: column numbers from 1, negative where the second has it."""
    one, other = ({column[f] for f in features_of(words) if f in column} for words in pair)
    return tuple(sorted([*(k + 1 for k in one - other), *(-k - 1 for k in other - one)]))


def penalty_matrix(differences: dict[tuple[int, ...], int], width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for pattern, n in sorted(differences.items()):
        at, sign = np.abs(pattern) - 1, np.sign(pattern)
        out[np.ix_(at, at)] += n * np.outer(sign, sign)
    return out


def newton_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> np.ndarray:
    """What to take from ``w``: gradient and curvature of the loss, plus those of the quadratic form ``hold`` / 2."""
    slope, bend = hold @ w, hold + 1e-8 * np.eye(len(w))
    for at in range(0, len(x), 500):
        part = x[at : at + 500].astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
        slope += part.T @ (p - y[at : at + 500])
        bend += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
    return np.linalg.solve(bend, slope)


def fit(chosen: list[str], x: np.ndarray, y: np.ndarray, differences: dict[tuple[int, ...], int], ridge: float = 0.3, fairness: float = 1.0) -> Model:
    """A model with the features ``chosen`` from rows of bits ``x`` and labels; without both labels, the constant base rate."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    constant = Model({}, float(np.log(base / (1 - base))))
    if not len(y) or y.min() == y.max() or not x.any():
        return constant
    x = np.hstack([x.astype(np.int8), np.ones((len(x), 1), dtype=np.int8)])
    hold = 2 * fairness * penalty_matrix(differences, x.shape[1]) + 2 * ridge * np.diag(np.append(np.ones(len(chosen)), 0.0))
    w = np.zeros(x.shape[1])
    w[-1] = constant.bias
    for _ in range(25):
        step = newton_step(w, x, y, hold)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Model({f: float(v) for f, v in zip(chosen, w, strict=False)}, float(w[-1]))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, zeros, ones): in how many texts of either label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def emptied() -> pa.RecordBatch:
        rows = [(f, counts[0][f], counts[1][f]) for f in counts[0].keys() | counts[1].keys()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["feature", "zeros", "ones"])

    for batch in portions(batches):
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[y].update(features_of(words_of(text)))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield emptied()
    yield emptied()


def _association(ones: Column, zeros: Column, n1: int, n0: int) -> Column:
    """Root of the log-likelihood ratio of a feature's four-fold table with the label."""
    n, own = n1 + n0, ones + zeros
    cells = ((ones, own * n1 / n), (zeros, own * n0 / n), (F.lit(n1) - ones, (F.lit(n) - own) * n1 / n), (F.lit(n0) - zeros, (F.lit(n) - own) * n0 / n))
    terms = [F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0)) for o, e in cells]
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (terms[0] + terms[1] + terms[2] + terms[3])))


def telling_features(sample: DataFrame, features: int) -> list[str]:
    """The features of ``sample`` (text, y) that tell labels apart better than the best of as many by chance would."""
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    counted = sample.select("text", "y").mapInArrow(_tally, "feature string, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    rated = counted.where("zeros + ones >= 4").withColumn("g", _association(F.col("ones"), F.col("zeros"), sizes[1], sizes[0]))
    rated = stage(rated.where("g >= 2").select("feature", "g").withColumn("all", F.lit(1)), "features")
    # About a twentieth of unrelated features reach 2, so this is close to the number that was tried.
    tried = 20 * rated.count()
    least = np.sqrt(2 * np.log(max(tried, 20)))
    return [r.feature for r in rated.where(F.col("g") >= float(least)).orderBy(F.col("g").desc(), "feature").limit(features).collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    most: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
    features: int = 384,
    **options,
) -> Model:
    """Fit on at most ``most`` labelled documents of each label outside fold ``held_out``, with at most ``features`` features beside those of identity terms."""
    return fit(*training_rows(stage(labelled_sample(docs, labels, label, folds, held_out, most, id_col, text_col), "labelled"), groups, features), **options)


def training_rows(sample: DataFrame, groups=IDENTITY_GROUPS, features: int = 384) -> tuple[list[str], np.ndarray, np.ndarray, dict[tuple[int, ...], int]]:
    """(chosen features, rows of bits, labels, differences of counterfactual pairs with their numbers) of ``sample`` (text, y), a staged table."""
    chosen = list(dict.fromkeys([*telling_features(sample, features), *(f for g in groups for w in g for f in word_features(w))]))
    column = {f: k for k, f in enumerate(chosen)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def made(bits: list, ys: list, patterns: list, numbers: list) -> pa.RecordBatch:
            columns = [pa.array(bits, pa.binary()), pa.array(ys, pa.int32()), pa.array(patterns, pa.list_(pa.int32())), pa.array(numbers, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["bits", "y", "pattern", "n"])

        for batch in portions(batches):
            bits = []
            texts, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text in texts:
                row = np.zeros(len(column), dtype=np.uint8)
                row[[column[f] for f in features_of(words_of(text)) if f in column]] = 1
                bits.append(np.packbits(row).tobytes())
                found.update(difference(pair, column) for pair in counterfactuals(text, groups))
            yield made(bits, ys, [None] * len(bits), [None] * len(bits))
        yield made([None] * len(found), [None] * len(found), list(found), list(found.values()))

    table = sample.select("text", "y").mapInArrow(rows, "bits binary, y int, pattern array<int>, n long").toArrow()
    documents = sorted((b, y) for b, y in zip(table.column("bits").to_pylist(), table.column("y").to_pylist(), strict=True) if b is not None)
    x = np.unpackbits(np.frombuffer(b"".join(b for b, _ in documents), dtype=np.uint8).reshape(len(documents), -(-len(chosen) // 8)), axis=1, count=len(chosen))
    differences: Counter = Counter()
    for pattern, n in zip(table.column("pattern").to_pylist(), table.column("n").to_pylist(), strict=True):
        if pattern:
            differences[tuple(pattern)] += n
    return chosen, x, np.array([y for _, y in documents], dtype=np.float64), dict(differences)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with the double column ``name``, 0 to 1; null and empty texts get the base score.

    A column already called ``name`` is replaced; other columns, or those of
    ``keep``, pass through untouched and are no part of the score.
    """
    return scored_rows(docs, model.scorer, text_col, name, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    ``held_out`` is false for null ids. Rows that repeat an id are scored each;
    equal texts get equal scores. Without labels of both kinds every text gets
    the base rate and none is predicted toxic. An empty table gives an empty result.
    """
    model = train(docs, labels, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "score", [id_col])
    return scored.select(id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "score", ((F.col("score") >= cut) & F.lit(not model.constant)).cast("int").alias("predicted"))
