"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, h = tanh(E x), from
features of its bytes and words; gated attention gives it the weight
softmax(a . (tanh(V h) * sigmoid(U h))) within its document, and the score is a
logistic function of the weighted sum of the passages' encodings. Encoder and
attention are learned together from document labels alone.

Training uses a bounded sample (``most`` documents of each label, with up to
``bag`` passages each, spread evenly over the text) and plain numpy: at most
70 MB of features reach the driver. Scoring streams whole texts, all their
passages, without a shuffle and holds one document's passages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .training import fold, labelled_sample, scored_rows

#: Words in a passage; the last one of a text may be shorter.
PASSAGE_WORDS = 96
#: Feature columns: 128 ASCII byte shares, other bytes, and five word statistics.
WIDTH = 134


def passages(text: str | bytes | None) -> list[list[bytes]]:
    raw = (text.encode() if isinstance(text, str) else text) or b""
    words = raw.split()
    return [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]


def encode_passages(text: str | bytes | None) -> np.ndarray:
    """A row of WIDTH features per passage; a text without words is one empty passage."""
    if text is None:
        text = b""
    own = passages(text)
    out = np.zeros((len(own), WIDTH), dtype=np.float32)
    for k, words in enumerate(own):
        if not words:
            continue
        counts = np.bincount(np.frombuffer(b" ".join(words), dtype=np.uint8), minlength=256)
        n = len(words)
        size = counts.sum()
        row = out[k]
        row[:128] = counts[:128] / size
        row[128] = counts[128:].sum() / size
        row[129] = len(set(words)) / n
        row[130] = sum(map(bytes.__eq__, words, words[1:])) / n
        row[131] = size / n / 10
        row[132] = np.log1p(max(map(len, words))) / 5
        row[133] = n / PASSAGE_WORDS
    # Square roots keep rare marks visible beside frequent letters.
    np.sqrt(out[:, :129], out=out[:, :129])
    return out


def spread(rows: np.ndarray, most: int) -> np.ndarray:
    """All rows, or ``most`` of them at even distances with the first and the last."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).round().astype(np.int64)]


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    v: np.ndarray
    u: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    bias: float

    def attention(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention weights of one document's passages."""
        h = np.tanh(((x - self.centre) / self.spread) @ self.encode + self.encode_bias)
        logits = (np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.attend
        a = np.exp(logits - logits.max())
        return h, a / a.sum()

    def score(self, text) -> float:
        h, a = self.attention(encode_passages(text))
        return float(_sigmoid(a @ h @ self.out + self.bias))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags; ``x`` has the passages of all bags, ``sizes`` how many each bag has."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    doc = np.repeat(np.arange(len(y)), sizes)
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    logits = (tv * su) @ p["attend"]
    e = np.exp(logits - np.maximum.reduceat(logits, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * h, starts)
    err = (_sigmoid(z @ p["out"] + p["bias"]) - y) / len(y)
    dz = err[:, None] * p["out"]
    da = (dz[doc] * h).sum(axis=1)
    dl = a * (da - np.add.reduceat(a * da, starts)[doc])
    gate = dl[:, None] * p["attend"]
    dv, du = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
    dh = (a[:, None] * dz[doc] + dv @ p["v"].T + du @ p["u"].T) * (1 - h**2)
    return {"encode": x.T @ dh, "encode_bias": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "attend": (dl[:, None] * tv * su).sum(axis=0), "out": z.T @ err, "bias": err.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gates: int = 8, epochs: int = 40, rate: float = 0.01, decay: float = 1e-3, batch: int = 128, seed: int = 5) -> Model:
    """Adam on the log loss of document labels; labels weigh as often as they occur."""
    rng = np.random.default_rng(seed)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    rows = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    centre = rows.mean(axis=0).astype(np.float64)
    spread = np.maximum(rows.std(axis=0), 0.02).astype(np.float64)
    p = {
        "encode": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)),
        "encode_bias": np.zeros(hidden),
        "v": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gates)),
        "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gates)),
        "attend": rng.normal(0, 0.1, gates),
        "out": np.zeros(hidden),
        "bias": np.array(np.log(base / (1 - base))),
    }
    if not len(y) or y.min() == y.max():
        return Model(centre, spread, **{k: (float(v) if k == "bias" else v) for k, v in p.items()})
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    turn = 0
    scaled = [((b - centre) / spread) for b in bags]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([scaled[i] for i in pick])
            sizes = np.array([len(scaled[i]) for i in pick])
            grads = gradients(p, x, sizes, y[pick])
            turn += 1
            step = rate * (1 - epoch / epochs) ** 0.5
            for k, g in grads.items():
                g = g + decay * p[k] * (k not in ("bias", "encode_bias"))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - step * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.999**turn)) + 1e-8)
    return Model(centre, spread, **{k: (float(v) if k == "bias" else v) for k, v in p.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, most: int = 2000, bag: int = 32, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fit on at most ``most`` labelled documents of each label outside fold ``held_out``, and ``bag`` passages of each."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bags = [spread(encode_passages(t), bag).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bags, pa.binary()), batch.column(2)], names=["d", "bag", "y"])

    sample = labelled_sample(docs, labels, label, folds, held_out, most, id_col, text_col)
    rows = sample.mapInArrow(encoded, "d long, bag binary, y int").toArrow().sort_by("d")
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in rows.column("bag").to_pylist()]
    return fit(bags, np.array(rows.column("y").to_pylist(), dtype=np.float64), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with the double column ``name``, 0 to 1; null and empty texts are one empty passage.

    A column already called ``name`` is replaced; the others, or those of
    ``keep``, pass through and are no part of the score.
    """
    return scored_rows(docs, lambda: model.score, text_col, name, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    ``held_out`` is false for null ids. Rows that repeat an id are scored each;
    equal texts get equal scores. Without labels of both kinds every text gets
    the base rate. An empty table gives an empty result.
    """
    model = train(docs, labels, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "score", [id_col])
    return scored.select(id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
