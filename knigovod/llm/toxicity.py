"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, A-Z lower-cased), each hashed to one of `SLOTS` numbers.
The score is the logistic of w0 + sum w_i + sum over pairs <v_i, v_j> x_i x_j. The pairwise part, worked out in
linear time from the sum and the squares of the factors, sees combinations that no single weight shows. It is
learned by AdaGrad on log loss.

Learning takes at most `SAMPLE` labelled texts, those with the least hash of the id: a documented bound, so the model
(of fixed size) is fitted in one task and is small enough to send to all. Scoring reads every whole text where it lies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knigovod.llm.decontaminate import words_of

SLOTS, FACTORS = 1 << 18, 4
#: At most so many labelled texts are learned from. A term is learned if at least `LEAST_TEXTS` of them hold it and it
#: goes with the label, if a share of `COMMON` of them holds it, `MANY` at least, or if it goes with the label together with
#: another term: more than `CHANCE` would ever let any of the pairs do.
SAMPLE, LEAST_TEXTS, CHI_SQUARED, COMMON, MANY, CHANCE = 20_000, 4, 25.0, 0.05, 100, 0.01
#: Counts of pairs held at a time.
PAIR_COUNTS = 4_000_000
#: Passes over the texts, and steps, at least.
EPOCHS, STEPS, RATE, L2 = 8, 40_000, 0.1, 1e-3


def slots_of(text: bytes) -> np.ndarray:
    """The numbers of a text's terms, each once."""
    out = {zlib.crc32(term) % SLOTS for term in set(words_of(text))}
    return np.fromiter(out, np.int64, len(out))


class Machine:
    """w0, weights and factors; slots that were not learned weigh nothing."""

    def __init__(self, bias: float, slots: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
        self.weights[slots], self.factors[slots] = weights, factors

    def score(self, slots: np.ndarray) -> float:
        w = self.weights[slots]
        known = slots[w != 0]
        value = self.bias + float(np.sum(self.weights[known], dtype=np.float64))
        if len(known):
            v = self.factors[known].astype(np.float64) / np.sqrt(len(known))
            value += 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(value, -30.0, 30.0))))


def chosen_slots(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms that are learned: those that go with the label beyond chance (chi-squared with one degree of freedom),
    those so common that their weights cannot fit single texts, and those that go with it in pairs, however rare."""
    flat = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(labels, [len(t) for t in texts]) if len(texts) else np.empty(0)
    n, toxic = max(len(texts), 1), max(float(np.sum(labels)), 1e-9)
    seen, bad = np.bincount(flat, minlength=SLOTS).astype(float), np.bincount(flat, weights=of, minlength=SLOTS)
    with np.errstate(divide="ignore", invalid="ignore"):
        square = n * (bad * n - seen * toxic) ** 2 / (seen * (n - seen) * toxic * max(n - toxic, 1e-9))
    chosen = (np.nan_to_num(square, posinf=0.0) >= CHI_SQUARED) & (seen >= LEAST_TEXTS) | (seen >= max(COMMON * n, MANY))
    chosen[paired_slots(texts, labels, seen, bad)] = True
    return np.flatnonzero(chosen)


def paired_slots(texts: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The terms of the pairs that go with the label more often than either of the two alone does, each text a set of terms.

    A pair in k texts, b of them toxic, counts if a share of b / k is too unlikely (Chernoff's bound) for texts that are toxic
    as often as those of its more toxic term: below `CHANCE` for all pairs that are looked at. Pairs of terms in too few
    toxic texts for that are not counted, of the others every one is, block by block."""
    share = float(np.mean(labels)) if len(labels) else 0.0
    if not 0.0 < share < 1.0:
        return np.empty(0, np.int64)
    fewest, terms = float(LEAST_TEXTS), np.empty(0, np.int64)
    for _ in range(2):  # the number of terms sets how unlikely a pair must be, and that the number of terms
        terms = np.flatnonzero(bad >= fewest)
        needed = np.log(max(len(terms) * (len(terms) - 1) / 2, 1) / CHANCE)
        fewest = max(fewest, needed / np.log(1 / share))
    terms = np.flatnonzero(bad >= fewest)
    where = np.full(SLOTS, -1, np.int64)
    where[terms] = np.arange(len(terms))
    rows = [np.sort(i[i >= 0]) for i in (where[t] for t in texts)]
    alone = bad[terms] / np.maximum(seen[terms], 1)
    found = np.zeros(len(terms), bool)
    step = max(1, PAIR_COUNTS // max(len(terms), 1))
    for low in range(0, len(terms), step):
        size = min(step, len(terms) - low)
        both, toxic = np.zeros((size, len(terms) - low), np.int32), np.zeros((size, len(terms) - low), np.int32)
        for row, label in zip(rows, labels):
            a, b = np.searchsorted(row, (low, low + size))
            if a < b:
                at = np.ix_(row[a:b] - low, row[a:] - low)
                both[at] += 1
                if label:
                    toxic[at] += 1
        x, y = np.nonzero(toxic >= fewest)
        x, y = x[y > x], y[y > x]
        k, b = both[x, y].astype(float), toxic[x, y].astype(float)
        p, q = np.maximum(alone[x + low], alone[y + low]), b / k
        with np.errstate(divide="ignore", invalid="ignore"):
            unlikely = b * np.log(q / p) + np.where(k > b, (k - b) * np.log((1 - q) / (1 - p)), 0.0)
        hit = (q > p) & (np.nan_to_num(unlikely) >= needed)
        found[x[hit] + low] = found[y[hit] + low] = True
    return terms[found]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(bias, slots, weights, factors). Texts are taken in the given order, one step each; all texts of one label
    give a constant score on that side."""
    slots = chosen_slots(texts, labels)
    where = np.full(SLOTS, -1, np.int64)
    where[slots] = np.arange(len(slots))
    rows = [where[t][where[t] >= 0] for t in texts]
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), random.normal(0, 0.01, (len(slots), FACTORS))
    gw, gv = np.full(len(slots), 1e-6), np.full((len(slots), FACTORS), 1e-6)
    share = float(np.mean(labels)) if len(labels) else 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    bias, gb = float(np.log(share / (1 - share))), 1.0
    if len(np.unique(labels)) < 2:
        return (bias, slots[:0], w[:0], v[:0])
    for _ in range(max(EPOCHS, -(-STEPS // len(rows)))):
        for k in random.permutation(len(rows)):
            i = rows[k]
            x = 1.0 / np.sqrt(max(len(i), 1))
            vi = v[i]
            total = vi.sum(axis=0) * x
            value = bias + w[i].sum() + 0.5 * (total @ total - (vi * vi).sum() * x * x)
            off = 1.0 / (1.0 + np.exp(-np.clip(value, -30.0, 30.0))) - labels[k]
            gb += off * off
            bias -= RATE * off / np.sqrt(gb)
            step = off * np.ones(len(i)) + L2 * w[i]
            gw[i] += step * step
            w[i] -= RATE * step / np.sqrt(gw[i])
            step = off * x * (total - vi * x) + L2 * vi
            gv[i] += step * step
            v[i] = vi - 0.3 * RATE * step / np.sqrt(gv[i])
    return bias, slots, w, v


def labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(doc_id, slots, toxic) of the texts to learn from."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.withColumnRenamed("_id", doc_id).filter(may_learn).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches):
        for batch in batches:
            slots = [slots_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "toxic": batch.column(1), "slots": pa.array([np.sort(s) for s in slots], pa.list_(pa.int64()))})

    # At most `sample` rows of two numbers: sent to the documents, so that texts stay where they are.
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    met = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return met.select(F.col("_id").cast("bigint").alias("id"), "toxic", "t").mapInArrow(
        run, "id bigint, toxic int, slots array<bigint>")


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE) -> tuple | None:
    """The parts of the `Machine` learned from the labelled rows for which `may_learn` (over doc_id) holds; None
    without any."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        # Rows that repeat an id count once.
        ids = np.asarray(table.column("id"))
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        slots = table.column("slots").combine_chunks()
        flat, edges = slots.values.to_numpy(), slots.offsets.to_numpy()
        texts = [flat[a:b] for a, b, keep in zip(edges[:-1], edges[1:], first) if keep]
        bias, slots, w, v = fit(texts, np.asarray(table.column("toxic"), dtype=float)[first])
        return pa.table({
            "bias": pa.array([bias], pa.float64()), "slots": pa.array([slots], pa.list_(pa.int64())),
            "w": pa.array([w], pa.list_(pa.float64())), "v": pa.array([v.reshape(-1)], pa.list_(pa.float64()))})

    # One group of at most `sample` rows.
    rows = labelled(docs, labels, may_learn, doc_id, text, label, sample).withColumn("g", F.lit(0)).groupBy("g").applyInArrow(
        run, "bias double, slots array<bigint>, w array<double>, v array<double>").collect()
    if not rows:
        return None
    bias, slots, w, v = rows[0]
    return bias, np.array(slots, np.int64), np.array(w), np.array(v).reshape(-1, FACTORS)


def toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) for each row of `docs`.

    Null and empty texts have no terms and score by the bias alone. Labels that are null, or of documents that are
    not there, are left out; repeated labels of one document count once, as the highest. Without labels every score
    is 0. Other columns, label and source among them, are no input of a score."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, may_learn, doc_id, text, label, sample))

    def run(batches):
        m = Machine(*model.value) if model.value else None
        for batch in batches:
            scores = [m.score(slots_of(t.as_py())) if m else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())})

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    return given.mapInArrow(run, "doc_id bigint, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text",
                  label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, all columns, that score below 0.5. They stay where they are; nulls as in `toxicity`."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, may_learn, doc_id, text, label, sample))
    at = docs.columns.index(text)

    def run(batches):
        m = Machine(*model.value) if model.value else None
        for batch in batches:
            keep = [m is None or m.score(slots_of((t.as_py() or "").encode())) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
