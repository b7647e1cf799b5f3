"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import WORD, lower_ascii, mix, ngram_hashes, text_chunks

BITS = 20
PAIR = 1 << (BITS - 1)   # buckets from here on are those of word pairs
PAIR_VALUE = 0.5         # what a pair counts beside a word: pairs are many and mostly met once


def _features(texts, keep=None):
    """Per text of the batch (in order) the distinct buckets of its features; with ``keep`` only buckets marked there.

    Features: words, their first four and first six bytes (so that unseen endings meet known stems), pairs of neighbours, and
    pairs with one word left out.  Yields (first text, number of texts, text of each bucket, bucket).
    """
    shift = np.uint64(64 - BITS + 1)
    for c in text_chunks(texts):
        c.split(WORD)
        c.prefix_hash(lower_ascii(c.buf))
        words = c.word_hashes()
        parts = [(words, c.doc, 0)]
        for length, salt in ((4, 0x51), (6, 0x52)):
            long = c.end - c.start > length
            parts.append((mix(c.span_hash(c.start[long], c.start[long] + length) + np.uint64(salt)), c.doc[long], 0))
        parts += [(*ngram_hashes(words, c.doc, 2, gap), PAIR) for gap in (0, 1)]
        docs, buckets = [], []
        for h, d, half in parts:
            b = (h >> shift).astype(np.int64) | half
            if keep is not None:
                k = keep[b]
                b, d = b[k], d[k]
            docs.append(d)
            buckets.append(b)
        both = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | np.concatenate(buckets))
        yield c.first, c.n, both >> BITS, both & ((1 << BITS) - 1)


class Ftrl:
    """Per-coordinate FTRL-proximal: each weight has its own learning rate and is exactly 0 until its evidence passes l1."""

    def __init__(self, alpha=1.0, beta=1.0, l1=4.0, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, buckets, label):
        at = np.append(buckets, 1 << BITS)  # the last coordinate is the intercept
        x = np.where((at & PAIR) > 0, PAIR_VALUE, 1.0)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def sparse(self):
        """Buckets with a weight, and the weight times the value of its feature."""
        w = self.weights(np.arange((1 << BITS) + 1))
        w[PAIR:1 << BITS] *= PAIR_VALUE
        at = np.flatnonzero(w)
        return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None, sample: int = 8_000, passes: int = 4, seed: int = 5):
    """Weights (buckets, values) learned from a sample of about ``sample`` labelled rows; that bound is the model's size.

    The sample is drawn by a hash of the key over all labelled rows, so it is spread evenly whatever the table's size.
    ``held_out`` is a condition on the key that no training row may meet.  Rows whose label or key is null teach nothing;
    a key labelled twice counts once, with the larger label.  Without labelled rows no weights are returned, and every
    score is 0.
    """
    usable = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key IS NOT NULL AND _y IS NOT NULL").groupBy("_key").agg(F.max("_y").alias("_y"))
    if held_out is not None:
        usable = usable.where(~held_out(F.col("_key")))
    n = usable.count()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = usable.where(draw < min(1.0, sample / n))  # about `sample` rows: small whatever the table
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def features(batches):
        for batch in batches:
            for first, count, doc, bucket in _features(batch.column(1)):
                cut = np.searchsorted(doc, np.arange(count + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count).cast(pa.int64()), batch.column(2).slice(first, count), lists], names=["k", "y", "f"])

    turns = rows.select("_key", "_text", "_y").mapInArrow(features, "k long, y int, f array<int>").withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    one = turns.withColumn("order", F.xxhash64(F.lit(seed), "turn", "k")).repartition(1).sortWithinPartitions("turn", "order", "f").select("y", "f")

    def train(batches):
        model = Ftrl()
        for batch in batches:
            lists = batch.column(1)
            cut, bucket = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, y in enumerate(batch.column(0).to_numpy(zero_copy_only=False)):
                model.learn(bucket[cut[i]:cut[i + 1]], y)
        at, w = model.sparse()
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    got = one.mapInArrow(train, "at long, w double").toPandas()  # at most 2**BITS + 1 weights; the penalty leaves a few thousand
    got = got[got.w != 0].sort_values("at")
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(float)


def score(docs: DataFrame, weights, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that a text is toxic; a null text counts as empty, an empty one gets the
    probability of the intercept alone.  A column that already has the name ``column`` is replaced."""
    at, w = weights
    model = docs.sparkSession.sparkContext.broadcast((at, w))

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        at, w = model.value
        if not len(at):
            return pa.array(np.zeros(len(texts)))
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        keep = dense[:-1] != 0
        total = np.full(len(texts), dense[-1])
        for first, count, doc, bucket in _features(texts, keep):
            total[first:first + count] += np.bincount(doc, weights=dense[bucket], minlength=count)
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return docs.withColumn(column, probability(F.col(text)))
