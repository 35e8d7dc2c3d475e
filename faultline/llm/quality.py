"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (``FEATURES``). A class has its mean and a covariance that is
shrunk towards the pooled one and towards a multiple of the identity; the score is the logistic function of the
difference of the two log densities, from Mahalanobis distances with the cached inverses of the Cholesky factors, plus
the log prior odds, both scaled by a slope and an offset that are fitted to the same labels.

The model is fitted on a bounded sample of at most about ``train_docs`` labelled documents, chosen by a hash of doc_id.

Defined results: null texts count as empty; the empty text has the score of its statistics; without labels of both
classes the score is the share of label 1, or 0.5 without labels; null labels are not learned from, repeated labels
count as often as they stand there; repeated documents give repeated results; further columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_text, narrow
from faultline.llm.langid import held_out

FEATURES = ("length", "letters", "upper", "marks", "symbols", "digits", "word_length", "distinct", "repeats", "stops", "title", "lines")
THRESHOLD = 0.3
#: Log density differences beyond count as this much.
SPAN = 200.0
#: Words that are added to a text's number of words, so that shares in short texts vary less.
SMOOTH = 10
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(97, 123), *range(0xC0, 0x100)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 5
_CLASS[10] = 6
_CLASS[[32, 9, 13, 11, 12]] = 7


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    by = np.zeros(8)
    for i in range(0, len(raw), 1 << 20):
        by += np.bincount(_CLASS[raw[i : i + (1 << 20)]], minlength=8)
    words = (text or "").split()
    n, w = max(1.0, len(raw)), max(1, len(words))
    alpha = max(1.0, by[1] + by[2])
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    title = sum(map(str.istitle, words))
    root = np.sqrt
    return [
        float(np.log1p(w)),
        float(root(1 - min(1.0, alpha / n))),
        float(root(by[2] / alpha)),
        float(root(by[4] / n)),
        float(root(by[5] / n)),
        float(root(by[3] / n)),
        float(np.log(n / w)),
        float(np.log((distinct + SMOOTH) / (w + SMOOTH))),
        float(root(repeats / (w + SMOOTH))),
        float(root(text.count(".") / w)) if text else 0.0,
        float(root(title / (w + SMOOTH))),
        float(root(by[6] / w)),
    ]


class Discriminant:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.01):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.classes = None
        if len(set(y.tolist())) < 2:
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.centre) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        scatter = [(p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) for p in parts]
        pooled = sum(scatter) / len(z)
        self.classes = []
        for p, s in zip(parts, scatter):
            own = s / len(p)
            cov = (1 - to_pooled - to_identity) * own + to_pooled * pooled + to_identity * max(np.trace(pooled) / len(own), 1e-3) * np.eye(len(own))
            factor = np.linalg.cholesky(cov)
            self.classes.append((p.mean(axis=0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

        self._calibrate(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log density of label 1 less that of label 0, within SPAN."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - log for mean, inverse, log in self.classes]
        return np.clip(density[1] - density[0], -SPAN, SPAN)

    def _calibrate(self, d: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the log odds by Newton's method, with targets a little inside of 0 and 1."""
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        design = np.stack([d, np.ones(len(d))], axis=1)
        beta = np.array([0.1, np.log(self.prior / (1 - self.prior))])

        def loss(b: np.ndarray) -> float:
            odds = design @ b
            return float((np.logaddexp(0, odds) - target * odds).sum())

        now = loss(beta)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (p - target))
            size = 1.0
            while size > 1e-6 and loss(beta - size * step) > now:
                size /= 2
            beta, before = beta - size * step, now
            now = loss(beta)
            if before - now < 1e-9 * max(1.0, now):
                break
        self.slope, self.offset = max(float(beta[0]), 1e-6), float(beta[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def fit(documents: DataFrame, labels: DataFrame, train_docs: int = 20_000) -> Discriminant:
    """Learn ``quality`` from the labelled documents that are not held out."""
    known = narrow(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~held_out())
    share = min(1.0, train_docs / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = narrow(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "doc_id", "quality")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = map_text(rows, run, f"doc_id long, quality {dict(known.dtypes)['quality']}, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = np.array(found["quality"].to_pylist(), dtype=int)
    order = np.lexsort([*x.T, y, np.array(found["doc_id"].to_pylist(), dtype=np.int64)])
    return Discriminant(x[order], y[order])


def score(documents: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([statistics(t) for t in b.column(1).to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = narrow(documents, "doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return map_text(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Discriminant) -> DataFrame:
    """The documents, all columns, that the model doesn't reject."""
    names = documents.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([statistics(t) for t in b.column(names.index("text")).to_pylist()]))
        return b.filter(pa.array(s >= THRESHOLD))

    return map_text(documents, run, documents.schema)
