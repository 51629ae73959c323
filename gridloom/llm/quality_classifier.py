"""Quality scores by supervised subword embeddings, trained with numpy gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrays import gram_hashes, joined, mix64, slices, utf8, word_hashes

BUCKETS = 1 << 16
GRAMS = (3, 5)
SAMPLE_ROWS = 3000


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, pair of neighbouring words and run of 3 or 5 bytes.

    A pair is hashed without regard to order, so that any word said twice in a row falls
    into one bucket.
    """
    words, rows = word_hashes(texts)
    same = rows[1:] == rows[:-1]
    pairs = mix64((words[1:] ^ words[:-1])[same] + np.uint64(1))
    data, of = joined(texts)
    hashed, places = [words, pairs], [rows, rows[1:][same]]
    for size in GRAMS:
        inside = of[: len(of) - size + 1] == of[size - 1 :] if len(of) >= size else np.zeros(0, bool)
        hashed.append(gram_hashes(data, size)[inside])
        places.append(of[: len(inside)][inside])
    return (np.concatenate(hashed) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(places)


@dataclass
class Model:
    """Embeddings averaged over a document's buckets, then a softmax layer with two outputs."""

    embeddings: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> np.ndarray:
        """Difference of the two outputs for a document that is one bucket; averages are linear."""
        return self.embeddings @ (self.output[1] - self.output[0])

    def margin(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(
    documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
    dims: int = 16, epochs: int = 6, rate: float = 0.25, seed: int = 5,
) -> Model:
    """Stochastic gradient descent on (buckets, counts) of each document, classes weighted evenly.

    Documents come in a fixed order, so that reruns agree.

    As in word-vector training the gradient of the average goes to each of its vectors in
    full, scaled by the share of the bucket in the document relative to the largest one.
    """
    draw = np.random.default_rng(seed)
    model = Model(
        draw.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32),
        np.zeros((2, dims), np.float32), np.zeros(2, np.float32),
    )
    counts = np.bincount(labels, minlength=2)
    if not counts.all():  # one class or none: its share is all there is to learn
        model.bias[:] = np.log((counts + 1) / (counts.sum() + 2))
        return model
    weight = counts.sum() / (2 * counts)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in draw.permutation(len(labels)):
            pace = rate * (1 - done / steps)
            done += 1
            buckets, n = documents[i]
            if not len(buckets):
                continue
            vectors = model.embeddings[buckets]
            mean = n @ vectors / n.sum()
            scores = model.output @ mean + model.bias
            odds = np.exp(scores - scores.max())
            slip = odds / odds.sum()
            slip[labels[i]] -= 1
            slip *= pace * weight[labels[i]]
            back = slip @ model.output
            model.output -= np.outer(slip, mean)
            model.bias -= slip
            model.embeddings[buckets] -= np.outer(n / n.max(), back)
    return model


def _packed(docs: DataFrame) -> DataFrame:
    """Distinct buckets and their counts of each document, as bytes."""

    def run(batches):
        for batch in slices(batches, "text"):
            buckets, rows = features(utf8(batch.column("text")))
            cells, n = np.unique(rows * BUCKETS + buckets, return_counts=True)
            cuts = np.searchsorted(cells, np.arange(batch.num_rows + 1) * BUCKETS)
            ids = [(cells[a:z] % BUCKETS).astype("<u4").tobytes() for a, z in zip(cuts, cuts[1:])]
            counts = [n[a:z].astype("<f4").tobytes() for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                names=["id", "label", "buckets", "counts"],
            )

    return docs.mapInArrow(run, "id long, label int, buckets binary, counts binary")


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_col.cast("string")) % 3 == 1


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out third.

    The sample is the first rows by a hash of the id, the same at any partitioning.  One task
    gets its bucket counts (bounded by sample_rows x 65 536) and trains; the driver gets the
    model's 65 536 weights.  Null labels, labels other than 0 and 1 and ids without text rows
    are passed over; if an id has several labels the smallest counts.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def learn(batches):
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(4)))]
        rows.sort()
        model = train(
            [(np.frombuffer(b, "<u4"), np.frombuffer(c, "<f4")) for _, _, b, c in rows], np.array([r[1] for r in rows], np.int64)
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights().astype("<f8").tobytes()]), pa.array([model.margin()])], names=["weights", "margin"]
        )

    sample = _packed(texts.join(F.broadcast(known), "id").select("id", "label", "text"))
    found = sample.repartition(1).mapInArrow(learn, "weights binary, margin double").first()
    return np.frombuffer(found["weights"], "<f8"), found["margin"]


def score(
    docs: DataFrame, weights: np.ndarray, margin: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``score`` of every row; the model sees the text only.

    A document's output is an average, so each bucket's part of it is looked up in one table
    of 65 536 numbers.  An empty or null text scores by the bias alone.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            buckets, rows = features(utf8(batch.column("text")))
            total = np.bincount(rows, weights[buckets], minlength=batch.num_rows)
            n = np.bincount(rows, minlength=batch.num_rows)
            logit = np.clip(total / np.maximum(n, 1) + margin, -50, 50)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(1 / (1 + np.exp(-logit)))], names=["id", "score"]
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (higher: label 1 likelier), ``predicted``.

    Without usable labels every score is 0.5.  A null id is never held out.
    """
    scored = score(docs, *fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
