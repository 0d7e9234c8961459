"""Toxicity by weak supervision.

Voters look at whole texts: lexicon voters (a fixed list of insults, and
lexicons of words and word stems induced from labelled training rows) and
pattern voters (shouting, exclamation bursts, second-person address, several
lexicon hits close together). A generative label model - which class a text
has, how often each voter fires in either class - is fitted to the counts of
vote patterns over all documents by expectation maximisation. Correlations
of voters within a class are estimated from the same posteriors, and voters
that agree beyond the class share their weight. A linear classifier (logistic,
L1-proximal, numpy) is then trained on the posterior labels of a bounded
sample of documents that aren't held out; it gives the score.

Labels are never read of held-out rows. At most ``SAMPLE`` labelled texts
induce the lexicons and join the classifier's training rows (the posterior of
a row with a known class is that class); counts of labelled vote patterns
anchor the label model. There are at most 16 voters, so at most 65,536
patterns reach the driver.

Null text is empty; a text without words has the score of the bias alone.
Without labelled rows only the fixed lexicon and the patterns vote; without
documents of both posterior classes every score is the class share.

An empty table gives an empty table. A very long text is read whole, in the
Arrow batch that holds it. Repeated rows and null ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import Shared, cut, keyed_text, large
from hirefold.llm.labelled import held_out, training_rows
from hirefold.llm.subwords import Words, blocks_of

SAMPLE = 6000
FIT = 2000
BITS = 20
LEXICONS = 10
#: Weight of a row with a known class in the label model.
ANCHOR = 3.0
TERMS = 120
STEMS = (4, 5, 6, 7)
# Insults of everyday English.
INSULTS = ("clown", "coward", "cretin", "disgusting", "dumb", "filthy", "fool", "garbage", "idiot", "imbecile", "jerk",
           "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
ADDRESS = ("you are ", "you're ", "du bist ", "tu es ", "eres ")


def _blocks(texts: list[str]) -> Iterator[Words]:
    return (Words(*piece, STEMS) for piece in blocks_of(texts))


def terms(text: str) -> np.ndarray:
    """Distinct hashes of the words and stems of a text."""
    found = [w.hashes.ravel() for w in _blocks([text])]
    return np.setdiff1d(np.concatenate(found), [0]).astype(np.uint32) if found else np.zeros(0, np.uint32)


def word_hash(word: str) -> int:
    return int(next(_blocks([word])).hashes[0, 0])


class Voters:
    """The votes of a text as bits: 0 the fixed lexicon, 1 shouting,
    2 exclamations, 3 address, 4 hits close together, 5.. induced lexicons."""

    FIXED = 5

    def __init__(self, lexicons: list[np.ndarray]):
        fixed = np.array([word_hash(w) for w in INSULTS], np.uint32)
        self.count = self.FIXED + len(lexicons)
        every = [fixed, *lexicons]
        bits = [1, *(1 << (self.FIXED + i) for i in range(len(lexicons)))]
        ids = np.unique(np.concatenate(every))
        self.ids, self.bits = ids, np.zeros(len(ids), np.int64)
        for lexicon, bit in zip(every, bits, strict=True):
            self.bits[np.searchsorted(ids, lexicon)] |= bit

        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[ids >> np.uint32(16)] = True

    def vote(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        upper = np.zeros(len(texts), np.int64)
        last = np.full(len(texts), -10**9)  # place of the last hit, and words so far
        words = np.zeros(len(texts), np.int64)
        for w in _blocks(texts):
            np.add.at(upper, w.owners, w.upper)
            row, place = np.nonzero(self.maybe[w.hashes >> np.uint32(16)])
            h = w.hashes[row, place]
            at = np.minimum(np.searchsorted(self.ids, h), len(self.ids) - 1)
            true = self.ids[at] == h
            order = np.argsort(place[true], kind="stable")
            place, bits = place[true][order], self.bits[at[true]][order]
            part = np.searchsorted(w.cuts, place, "right") - 1
            for p in np.unique(part):
                i, mine = w.owners[p], part == p
                out[i] |= int(np.bitwise_or.reduce(bits[mine]))
                places = np.r_[last[i], np.unique(place[mine]) - w.cuts[p] + words[i]]
                if (np.diff(places) <= 20).any():
                    out[i] |= 16
                last[i] = places[-1]
            np.add.at(words, w.owners, np.diff(w.cuts))
        for i, t in enumerate(texts):
            low = t.lower()
            out[i] |= (2 * (upper[i] > 0.3 * max(20, len(t))) | 4 * (t.count("!!") >= 3)
                       | 8 * any(x in low for x in ADDRESS))
        return out


def induce_lexicons(rows: list[tuple[np.ndarray, int]], n: int = LEXICONS, most: int = TERMS) -> list[np.ndarray]:
    """Lexicons from (terms, label) rows: terms at least nine times as
    frequent in toxic texts, chosen to cover the toxic rows, dealt round robin."""
    toxic = [t for t, y in rows if y == 1]
    clean = [t for t, y in rows if y == 0]
    if not toxic or not clean:
        return []
    ids, n_toxic = np.unique(np.concatenate(toxic), return_counts=True)
    c_ids, c_n = np.unique(np.concatenate(clean), return_counts=True)
    n_clean = np.zeros(len(ids))
    at = np.minimum(np.searchsorted(c_ids, ids), max(0, len(c_ids) - 1))
    n_clean = np.where(c_ids[at] == ids, c_n[at], 0) if len(c_ids) else n_clean
    good = ((n_toxic >= max(5, 0.004 * len(toxic)))
            & (n_toxic / len(toxic) >= 9 * (n_clean + 0.5) / len(clean)))
    ids, n_toxic = ids[good], n_toxic[good]
    # Each round takes the term of the most rows that have few chosen terms yet.
    has = [np.searchsorted(ids, t[np.isin(t, ids)]) for t in toxic]
    need = np.ones(len(toxic))
    owner = np.repeat(np.arange(len(toxic)), [len(h) for h in has])
    term = np.concatenate(has) if has else np.zeros(0, np.int64)
    chosen: list[int] = []
    for _ in range(min(most, len(ids))):
        gain = np.bincount(term, need[owner], len(ids))
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < 3:
            break
        chosen.append(best)
        need[owner[term == best]] *= 0.3
    return [ids[sorted(chosen[i::n])] for i in range(min(n, len(chosen)))]


def label_model(patterns: np.ndarray, counts: np.ndarray, voters: int, known: np.ndarray | None = None,
                rounds: int = 60) -> dict:
    """Fits the generative model to counted vote patterns: class share, firing
    rates of each voter by class (its accuracies), correlations within the
    classes, and the posterior of each pattern. ``known`` (2 x patterns):
    counts of rows whose class is known; they anchor the rates."""
    known = np.zeros((2, len(patterns))) if known is None else known * ANCHOR
    votes = (patterns[:, None] >> np.arange(voters)) & 1
    lexical = votes[:, [0, *range(Voters.FIXED, voters)]].any(axis=1)
    post = np.where(lexical, 0.9, 0.02)
    weight = np.ones(voters)
    total = counts.sum()
    for step in range(rounds):
        mass = np.stack([counts * (1 - post), counts * post])
        share = np.clip(mass.sum(axis=1) / total, 1e-4, 1)
        mass = mass + known
        rate = np.clip((mass @ votes + 0.1) / (mass.sum(axis=1)[:, None] + 1.0), 1e-6, 1 - 1e-6)
        if step % 10 == 9:  # correlations given the class
            corr = np.zeros((voters, voters))
            for y in (0, 1):
                d = votes - rate[y]
                cov = (d * mass[y][:, None]).T @ d / max(mass[y].sum(), 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr += mass[y].sum() / mass.sum() * cov / sd / sd[:, None]
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        fires = (np.log(rate[1] / rate[0]) * weight, np.log((1 - rate[1]) / (1 - rate[0])) * weight)
        z = np.log(share[1] / share[0]) + votes @ fires[0] + (1 - votes) @ fires[1]
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return {"share": share, "rate": rate, "correlation": corr, "weight": weight, "posterior": post}


class Linear:
    """Logistic regression over hashed terms by FTRL-proximal steps (L1 keeps
    terms that say nothing at zero, whatever the length of a text)."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.weights = np.zeros(1 << bits, np.float32)
        self.bias = 0.0

    def fold(self, term: np.ndarray) -> np.ndarray:
        return term >> np.uint32(32 - self.bits)

    def sums(self, texts: list[str]) -> np.ndarray:
        """Weight of each text's distinct terms, and the bias."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        some = self.weights != 0
        for w in _blocks(texts):
            ids = self.fold(w.hashes)
            row, place = np.nonzero(some[ids] & (w.hashes != 0))
            ids, part = ids[row, place], np.searchsorted(w.cuts, place, "right") - 1
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(w.owners) + 1))
            for p, i in enumerate(w.owners):
                if cuts[p] < cuts[p + 1]:
                    found[i].append(ids[order[cuts[p]:cuts[p + 1]]])
        return np.array([self.weights[np.unique(np.concatenate(f))].sum(dtype=np.float64) if f else 0.0
                         for f in found], np.float64) + self.bias

    def fit(self, rows: list[tuple[np.ndarray, float]], epochs: int = 4, alpha: float = 0.5, l1: float = 2.0,
            l2: float = 0.5, fewest: int = 8, seed: int = 11) -> Linear:
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        zb = nb = 0.0
        rng = np.random.default_rng(seed)
        # Terms of a few rows say nothing that carries over.
        often = np.bincount(np.concatenate([ids for ids, _ in rows]), minlength=1 << self.bits) >= fewest
        rows = [(ids[often[ids]], y) for ids, y in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, y = rows[i]
                w = np.where(np.abs(z[ids]) <= l1, 0.0,
                             -(z[ids] - np.sign(z[ids]) * l1) / (l2 + np.sqrt(n[ids]) / alpha))
                b = -zb / (l2 + np.sqrt(nb) / alpha)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
                grow = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
                z[ids] += g - grow * w
                n[ids] += g * g
                zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
                nb += g * g
        self.weights = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / (l2 + np.sqrt(n) / alpha)).astype(np.float32)
        self.bias = float(-zb / (l2 + np.sqrt(nb) / alpha))
        return self


def _terms(batches):
    for b in batches:
        blobs = [terms(t).astype("<u4").tobytes() for t in large(b.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(blobs, pa.binary())],
                                         ["doc_id", "label", "terms"])


def _gather(rows: DataFrame) -> list[tuple[np.ndarray, float]]:
    """Terms and label of a bounded sample (doc_id, text, label), in order."""
    got = rows.select("doc_id", "text", F.col("label").cast("double").alias("label")).mapInArrow(
        _terms, "doc_id long, label double, terms binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["terms"]))
    return [(np.frombuffer(r["terms"], "<u4"), r["label"]) for r in got]


def votes(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pattern) of every row: the voters' bits."""
    shared = Shared(docs.sparkSession, voters)

    def run(batches):
        for b in batches:
            v = shared.value.vote(large(b.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v, pa.int32())], ["doc_id", "pattern"])
    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, pattern int")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, fit: int = FIT,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[Linear, dict]:
    """The linear classifier and the label model it was trained with."""
    rows = keyed_text(docs, id_col, text_col)
    seen = _gather(training_rows(rows, labels, label, sample))
    voters = Voters(induce_lexicons(seen))
    cast = cut(votes(docs, voters, id_col, text_col))
    truth = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
             .where("y in (0, 1)").where(~held_out(F.col("doc_id"))))
    counted = cast.groupBy("pattern").count().toArrow()  # at most 2**16 rows
    known = cast.join(truth, "doc_id").groupBy("pattern", "y").count().toArrow().to_pylist()  # twice that
    patterns, counts = counted.column("pattern").to_numpy(), counted.column("count").to_numpy()
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    if not len(patterns):
        return Linear(), {}
    anchors = np.zeros((2, len(patterns)))
    for r in known:
        anchors[r["y"], np.searchsorted(patterns, r["pattern"])] += r["count"]
    model = label_model(patterns, counts, voters.count, anchors)
    table = docs.sparkSession.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, model["posterior"], strict=True)], "pattern int, label double")
    soft = (cast.where("doc_id is not null").where(~held_out(F.col("doc_id")))
             .join(F.broadcast(table), "pattern").select("doc_id", "label"))
    draw = F.xxhash64(F.lit("fit"), "doc_id")
    picked = None
    for side in (F.col("label") >= 0.5, F.col("label") < 0.5):
        part = soft.where(side).orderBy(draw, "doc_id", "label").limit(fit // 2)
        picked = part if picked is None else picked.union(part)
    data = _gather(rows.join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id"))  # at most ``fit`` short rows
    linear = Linear()
    # Posterior labels; of rows with a known class the posterior is that class.
    data = [(np.unique(linear.fold(t)), y) for t, y in [*data, *seen]]
    if len({y >= 0.5 for _, y in data}) == 2:
        linear.fit(data)
    else:
        linear.bias = float(np.log(model["share"][1] / model["share"][0]))
    return linear, model


def score_toxicity(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; higher: toxic likelier)."""
    shared = Shared(docs.sparkSession, model)  # 2**BITS floats

    def run(batches):
        m = shared.value
        for b in batches:
            z = m.sums(large(b.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             ["doc_id", "score"])
    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model, _ = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their
    columns; every row is judged by its own text, in place."""
    model, _ = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in text:
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.sums(t.tolist()), -30, 30))))
    return docs.where(score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) < threshold)
