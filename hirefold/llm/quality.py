"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed into buckets, each with a
learned vector; a document is the average of its features' vectors, and a
softmax over two classes reads it. The vectors and the softmax are trained by
numpy stochastic gradient descent on a bounded sample of labelled rows
(``SAMPLE``); the features of the sample are computed by tasks.

Scoring needs per bucket only the difference of the two class scores, which
tasks get by broadcast (2**BITS floats); every text is read whole.

Null text is empty; an empty text has the score of the bias alone. Without
labelled rows of both classes every score is 0.5.

An empty table gives an empty table. A very long text is read whole, in the
Arrow batch that holds it. Repeated rows and null ids are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import Shared, keyed_text, large
from hirefold.llm.labelled import held_out, training_rows
from hirefold.llm.subwords import counted, scores

BITS = 18
DIM = 10
#: Labelled rows that a fit reads at most, and passes over them.
SAMPLE = 4000
EPOCHS = 5
#: Steps at least, so that a small sample is passed over more often.
STEPS = 12_000
RATE = 0.25


def _counted(batches):
    for b in batches:
        ids, n = [], []
        for t in large(b.column("text")).to_pylist():
            u, c = counted(t, BITS)
            ids.append(u.astype("<u4").tobytes())
            n.append(c.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array(ids, pa.binary()), pa.array(n, pa.binary())],
            ["doc_id", "label", "ids", "n"])


class SubwordModel:
    """Bucket vectors (2**bits x dim) and a two-class softmax over their mean."""

    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.out = np.zeros((2, dim), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
            seed: int = 7) -> SubwordModel:
        """``rows``: (distinct features, their counts, label)."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-STEPS // max(1, len(rows))))
        steps, done = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, n, label = rows[i]
                lr = rate * (1 - done / steps)
                done += 1
                share = (n / n.sum())[:, None] if len(n) else np.zeros((0, 1), np.float32)
                own = self.vectors[ids]
                mean = (own * share).sum(axis=0) if len(n) else np.zeros(self.out.shape[1], np.float32)
                z = self.out @ mean + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = self.out.T @ p
                self.out -= lr * np.outer(p, mean)
                self.bias -= lr * p
                if len(n):  # a frequent feature moves more, scaled so that one text moves like one word
                    self.vectors[ids] = own - (lr * np.sqrt(len(n))) * share * back
        return self

    def bucket_scores(self) -> tuple[np.ndarray, float]:
        """Per bucket the score of class 1 less class 0, and the bias."""
        return self.vectors @ (self.out[1] - self.out[0]), float(self.bias[1] - self.bias[0])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
                id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    rows = training_rows(keyed_text(docs, id_col, text_col), labels, label, sample)
    got = rows.mapInArrow(_counted, "doc_id long, label int, ids binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["ids"]))
    data = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["n"], "<f4"), r["label"]) for r in got]
    if len({x[2] for x in data}) < 2:
        return SubwordModel()  # scores 0.5
    return SubwordModel().fit(data)


def score_quality(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; higher: class 1 likelier)."""
    weights, bias = model.bucket_scores()
    shared = Shared(docs.sparkSession, weights.astype(np.float32))  # 2**BITS floats: 1 MB
    bits = int(np.log2(len(weights)))

    def run(batches):
        for b in batches:
            z = scores(large(b.column("text")).to_pylist(), shared.value, bits) + bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             ["doc_id", "score"])
    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_quality(docs, fit_quality(docs, labels, sample=sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
