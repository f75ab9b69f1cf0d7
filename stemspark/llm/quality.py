"""A quality classifier of supervised subword embeddings.

Words, pairs of neighbouring words and the character n-grams of words (three and four characters) are hashed into one
table of learned vectors. A word's vector is the mean of its own and the average of its n-grams'; a document is the
average over its words and pairs, a softmax layer gives the probabilities of the labels, and stochastic gradient
descent in numpy trains both on the gradient of the log loss. As the layer is linear in the average, a document's score
is a weighted average of one number for each feature, which is how whole texts are scored.

The model is fitted in one task on a bounded sample: TRAIN_DOCS labelled documents, those whose ids have the least
hashes, each by at most TRAIN_CHARS characters (of a longer text its beginning, middle and end); every document is
scored over its whole text.

Defined results: a null, empty or blank text has no features and its score is that of the bias; several labels of
one id count as the least of them; rows without an id are scored as any other and are not held out; ids that are no
integers are refused; without labelled rows every score is 0.5; an empty table gives an empty table; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import long_id

TRAIN_DOCS, TRAIN_CHARS = 4000, 60_000
BUCKET_BITS, DIMENSION = 20, 8
GRAMS = (3, 4)
#: What part of a word its character n-grams are.
SUBWORDS = 0.5
#: Passes over the sample; first steps of the layer, its bias and the vectors, which fall to 0 in a line. A feature's
#: part of a document is small, and so is the gradient of its vector: its steps are longer.
EPOCHS, RATE, BIAS_RATE, VECTOR_RATE = 12, 0.5, 0.05, 30.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def features(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a block's words, their character n-grams and pairs of neighbouring words, the text of each, and what each
    counts in its text's average: a pair 1, a word and its n-grams 1 together (SUBWORDS of it for the n-grams, if any)."""
    found = W.words(block, lower=True)
    data = W.LOWER[block.data]
    owner = W.owner(found.at)
    at, pair = W.windows(found, 2, 9)
    begin = np.flatnonzero(((data & 0xC0) != 0x80) & W.CLASSES["space"][data])  # characters of words
    word = np.searchsorted(found.start, begin, "right") - 1
    last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
    end = np.where(last, found.end[word], np.append(begin[1:], len(data)))
    grams, of = [], []
    for n in GRAMS:
        k = np.arange(max(0, len(begin) - n + 1))
        k = k[word[k] == word[k + n - 1]]
        grams.append(W.spans_hash(data, begin[k], end[k + n - 1]) + W.U64(n))
        of.append(word[k])
    of = np.concatenate(of)
    count = np.bincount(of, minlength=len(owner))
    bucket = (W.mix(np.concatenate([found.hash, pair, *grams]), 5) >> W.U64(64 - BUCKET_BITS)).astype(np.int64)
    share = np.concatenate([np.where(count > 0, 1 - SUBWORDS, 1.0), np.ones(len(at)), SUBWORDS / np.maximum(count, 1)[of]])
    return bucket, np.concatenate([owner, owner[at], owner[of]]), share


class Model:
    """The number of each bucket that scores are averages of, and what is added to the average."""

    def __init__(self, weight: np.ndarray, offset: float):
        self.weight, self.offset = weight, offset

    def scores(self, block: W.Block) -> np.ndarray:
        bucket, text, share = features(block)
        n = len(block.at) - 1
        total, count = np.bincount(text, self.weight[bucket] * share, n), np.bincount(text, share, n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.offset)))


def gradient(rows: np.ndarray, share: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log loss of a document (vectors of its features, their shares) and its gradients by rows, layer and bias."""
    hidden = share @ rows
    logits = layer @ hidden + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    loss = -float(np.log(max(p[label], 1e-300)))
    p[label] -= 1
    return loss, np.outer(share, layer.T @ p), np.outer(p, hidden), p


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> Model:
    """docs: distinct buckets, their shares of the document, and the label (0 or 1) of each."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSION)) / DIMENSION
    layer, bias = np.zeros((2, DIMENSION)), np.zeros(2)
    total = EPOCHS * len(docs)
    for step in range(total):
        if step % len(docs) == 0:
            order = rng.permutation(len(docs))
        bucket, share, label = docs[order[step % len(docs)]]
        _, by_rows, by_layer, by_bias = gradient(vectors[bucket], share, layer, bias, label)
        left = 1 - step / total
        vectors[bucket] -= VECTOR_RATE * left * by_rows
        layer -= RATE * left * by_layer
        bias -= BIAS_RATE * left * by_bias
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = []
    for batch in batches:
        label = batch.column(1).to_pylist()
        for block in W.blocks(batch.column(0)):
            bucket, text, share = features(block)
            order = np.argsort(text, kind="stable")
            at = np.searchsorted(text[order], np.arange(len(block.at)))
            for k in range(len(block.at) - 1):
                mine = order[at[k] : at[k + 1]]
                some, where = np.unique(bucket[mine], return_inverse=True)
                if len(some):
                    n = np.bincount(where, share[mine])
                    docs.append((some, n / n.sum(), int(label[block.first + k])))
    if docs:
        m = train(docs)
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.astype("<f4").tobytes()], pa.binary()), pa.array([m.offset])], names=["weight", "offset"])


def held_out(id_: Column) -> Column:
    """Whether an id's labels are kept from training: CRC-32 of its text modulo FOLDS."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """A model from the labelled documents that aren't held out."""
    known = labels.select(long_id(labels), label_col).where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    third, n = TRAIN_CHARS // 3, F.length("text")
    part = F.concat_ws(" ", F.substring("text", 1, third), F.substring(F.col("text"), (n / 2).cast("int"), F.lit(third)), F.substring("text", -third, third))
    text = F.when(n <= TRAIN_CHARS, F.col("text")).otherwise(part)
    sample = docs.select(long_id(docs), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")  # TRAIN_DOCS ids at most
    sample = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", text.alias("text"), "label").orderBy("h", "doc_id", "text").limit(TRAIN_DOCS)
    rows = sample.select("text", "label").coalesce(1).mapInArrow(_train_task, "weight binary, offset double").collect()
    if not rows:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return Model(np.frombuffer(rows[0].weight, "<f4"), rows[0].offset)


def _score_task(weight: np.ndarray, offset: float) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weight.astype(float), offset)
        for batch in batches:
            parts = [model.scores(b) for b in W.blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return task


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = docs.select(long_id(docs), "text").mapInArrow(_score_task(model.weight, model.offset), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
