"""Masked pseudo-likelihood: a window network predicts every word from both sides and scores documents.

The network predicts one of a fixed number of buckets; which word of the bucket it is comes from the corpus counts of all words,
a Spark table with a row per distinct word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, land
from .textvec import SPACE, lower_ascii, mix, text_chunks

CODE = 6                 # a word is one of 64 classes and one of 64 members in it, both from its hash
CLASSES = 1 << CODE
VOCABULARY = 1 << (2 * CODE)
REACH = 3                # words on either side that a prediction sees
EDGE = VOCABULARY        # stands for what lies beyond a text's ends
SAFE = 80.0              # exponents between -SAFE and SAFE, and sums of CLASSES of them, fit single precision
COUNTED = 1 << 21        # words that a task counts at once
COMMON = 1 << 18         # words with at least this part of all words are looked up in the tasks, the others by a join; there are at most so many


def _words(texts):
    """Per chunk: the chunk and the hash of every word."""
    for c in text_chunks(texts):
        c.split(~SPACE)
        c.prefix_hash(lower_ascii(c.buf))
        yield c, c.word_hashes()


def _bucket(hashes):
    return (hashes >> np.uint64(64 - 2 * CODE)).astype(np.int64)


def _windows(tokens, doc, at=None):
    """The 2 * REACH neighbours of every word (or of those at the positions ``at``), EDGE beyond its text."""
    n = len(tokens)
    if at is None:
        out = np.full((n, 2 * REACH), EDGE, np.int64)
        for k in range(1, REACH + 1):
            if n > k:
                same = doc[k:] == doc[:-k]
                out[k:, REACH - k] = np.where(same, tokens[:-k], EDGE)
                out[:-k, REACH + k - 1] = np.where(same, tokens[k:], EDGE)
        return out
    out, mine = np.empty((len(at), 2 * REACH), np.int64), doc.take(at)
    for column, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        beside = at + step
        inside = (beside >= 0) & (beside < n)
        beside *= inside                                      # a place beyond the row of texts reads the first word and is not taken
        out[:, column] = np.where(inside & (doc.take(beside) == mine), tokens.take(beside), EDGE)
    return out


class Network:
    """Embeddings per neighbour position, a tanh layer, and two softmaxes: class, then member of the class.

    p(bucket | both sides) = p(class | hidden) * p(member | class, hidden); both start from the corpus counts.
    ``totals`` are the words per bucket; ``fit`` sets ``words``, the table of ``word_counts`` (h, n), which stays with Spark.
    """

    words = None

    def __init__(self, counts, width=16, seed=3):
        r = np.random.default_rng(seed)
        self.totals = np.asarray(counts, float)
        c = (counts + 0.5).reshape(CLASSES, CLASSES).astype(np.float32)
        self.e = (r.standard_normal((VOCABULARY + 1, width)) * 0.1).astype(np.float32)
        self.mixing = (np.tile(np.eye(width), (2 * REACH, 1, 1)) * 0.6 + r.standard_normal((2 * REACH, width, width)) * 0.05).astype(np.float32)
        self.u = np.zeros((width, CLASSES), np.float32)
        self.ub = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.v = np.zeros((CLASSES, width, CLASSES), np.float32)
        self.vb = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
        self.seen = {}

    PARTS = ("e", "mixing", "u", "ub", "v", "vb")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def flat(self):
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def load(self, flat):
        at = 0
        for p in self.PARTS:
            old = getattr(self, p)
            setattr(self, p, flat[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def hidden(self, windows, mapped):
        """``mapped``: the table of embeddings as each neighbour position maps it."""
        h = mapped[0].take(windows[:, 0], axis=0)
        for k in range(1, 2 * REACH):
            h += mapped[k].take(windows[:, k], axis=0)
        return np.tanh(h, out=h)

    @staticmethod
    def _exp(x):
        """``x`` becomes its exponentials; rows that could leave the range of single precision are shifted by their maximum first."""
        shift = 0
        if not (x.max(initial=-SAFE) < SAFE and x.min(initial=SAFE) > -SAFE):
            shift = x.max(1, keepdims=True)
            x -= shift
        return np.exp(x, out=x), shift

    @classmethod
    def _log_softmax_at(cls, x, which):
        """The entry ``which`` of every row's log-softmax; ``x`` is used up."""
        got = x[np.arange(len(x)), which]
        e, shift = cls._exp(x)
        return got - np.ravel(shift) - np.log(e @ np.ones(x.shape[1], x.dtype))

    @classmethod
    def _softmax(cls, x, sign=1):
        x, _ = cls._exp(x)
        x *= (np.float32(sign) / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
        return x

    def _with_bias(self):
        """Weights of the members with their offsets as one more row: classes, width + 1, members."""
        return np.concatenate([self.v, self.vb[:, None]], axis=1)

    def log_probability(self, tokens, windows):
        """Log-probability of each word given its neighbours."""
        out = np.empty(len(tokens))
        mapped, members = [self.e @ m for m in self.mixing], self._with_bias()
        step = 1 << 13                                        # what a step works on stays in the cache
        for a in range(0, len(tokens), step):
            t = tokens[a:a + step]
            order = np.argsort((t >> CODE).astype(np.uint8), kind="stable")
            t, h = t[order], self.hidden(windows[a:a + step].take(order, axis=0), mapped)
            kind, member = t >> CODE, t & (CLASSES - 1)
            got = self._log_softmax_at(h @ self.u + self.ub, kind)
            sizes = np.bincount(kind, minlength=CLASSES)
            h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
            low = np.empty((len(h), CLASSES), h.dtype)
            i = 0
            for k in np.flatnonzero(sizes).tolist():
                j = i + int(sizes[k])
                np.matmul(h[i:j], members[k], out=low[i:j])
                i = j
            out[a + order] = got + self._log_softmax_at(low, member).astype(float)
        return out

    def learn(self, tokens, windows, rate):
        """One step of gradient ascent on a batch of masked words; every part's step is scaled by its own squared gradients."""
        order = np.argsort((tokens >> CODE).astype(np.uint8), kind="stable")
        tokens, windows = tokens[order], windows.take(order, axis=0)  # the words of a class lie together
        n, width = len(tokens), self.e.shape[1]
        x = self.e.take(windows, axis=0).reshape(n, -1)       # n, 2R * d
        wide = np.ones((n, width + 1), np.float32)            # the hidden values and a one for the offsets
        h = np.tanh(x @ self.mixing.reshape(-1, width), out=wide[:, :width])
        kind, member = tokens >> CODE, tokens & (CLASSES - 1)
        top = self._softmax(wide @ np.concatenate([self.u, self.ub[None]]), -1)
        top[np.arange(n), kind] += 1
        dh = top @ self.u.T
        cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        classes = [(k, cut[k], cut[k + 1]) for k in range(CLASSES) if cut[k] < cut[k + 1]]
        members, low = self._with_bias(), np.empty((n, CLASSES), np.float32)
        for k, i, j in classes:
            np.matmul(wide[i:j], members[k], out=low[i:j])
        low = self._softmax(low, -1)
        low[np.arange(n), member] += 1
        gv, back = np.zeros_like(members), np.empty((n, width), np.float32)
        for k, i, j in classes:
            np.matmul(wide[i:j].T, low[i:j], out=gv[k])
            np.matmul(low[i:j], self.v[k].T, out=back[i:j])
        dh += back
        gu = wide.T @ top
        da = dh * (1 - h * h)
        gm = (x.T @ da).reshape(self.mixing.shape)
        # rows of e that no window shows have no gradient and stay as they are
        flat = windows.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat.take(order)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        shown, mapped = flat[first], (da @ self.mixing.reshape(-1, width).T).reshape(-1, width).take(order, axis=0)
        # two numbers at a time, as the sums of rows are many and short
        ge = np.add.reduceat(mapped.view(np.complex64), first).view(np.float32) if width % 2 == 0 else np.add.reduceat(mapped, first)
        for part, at, g in (("e", shown, ge), ("mixing", ..., gm), ("u", ..., gu[:-1]), ("ub", ..., gu[-1]), ("v", ..., gv[:, :-1]), ("vb", ..., gv[:, -1])):
            whole = getattr(self, part)
            if part not in self.seen:
                self.seen[part] = np.zeros_like(whole)
            root = g * g
            root += self.seen[part][at]
            self.seen[part][at] = root
            np.sqrt(root, out=root)
            root += np.float32(1e-3)
            g *= np.float32(rate)
            g /= root
            whole[at] += g


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct word of the table by its hash with its number: h, n."""
    def counted(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for _, words in _words(batch.column(0)):
                parts.append(words)
                held += len(words)
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)

    return docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _bucket_counts(words: DataFrame) -> np.ndarray:
    got = words.groupBy(F.shiftrightunsigned("h", 64 - 2 * CODE).cast("int").alias("at")).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY)
    out[got["at"]] = got["n"]
    return out


def corpus_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Words of the whole table per bucket: VOCABULARY numbers."""
    return _bucket_counts(word_counts(docs, text))


def fit(docs: DataFrame, text: str = "text", masked: int = 8, rounds: int | None = None, rate: float = 0.08, seed: int = 3, batch_words: int = 2048) -> Network:
    """Train on every word of all texts.  Each round every partition trains its own copy from the shared network on its texts,
    and the copies are averaged, weighted by the words they saw; the average is what the next round starts from.

    Words fall into ``masked`` classes by a hash of their place and bucket; a round masks and predicts those of one class, in
    turn, and sees all others as neighbours.  There are as many rounds as classes unless ``rounds`` says otherwise, so every word
    is predicted once.  Buckets are written once, two bytes a word, and read by every round.  The average is summed by
    Spark in slices of the parameters, so the driver receives one network whatever the number of partitions.  A copy is a
    partition's: how the table is split decides which words share one between two averages.
    """
    words_table = land(word_counts(docs, text), "lm-words")
    counts = _bucket_counts(words_table)
    net = Network(counts, seed=seed)
    net.words = words_table
    spark = docs.sparkSession
    slice_of = 4096

    def coded(batches):
        for batch in batches:
            for c, hashes in _words(batch.column(0)):
                if len(hashes):
                    # an EDGE before every text with words
                    tokens = np.insert(_bucket(hashes), c.word_offsets[:-1][c.counts > 0], EDGE).astype(np.uint16)
                    yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens.tobytes()], pa.binary())})

    texts = land(docs.select(text).mapInArrow(coded, "tokens binary"), "lm-tokens")
    for turn in range(masked if rounds is None else rounds):
        start = spark.sparkContext.broadcast(net.flat())

        def train(batches, turn=turn, start=start):
            mine, words = Network(counts).load(start.value), 0
            rest_t, rest_w = [], []
            for batch in batches:
                for coded_text in batch.column(0):
                    tokens = np.frombuffer(coded_text.as_py(), np.uint16).astype(np.int64)
                    doc, inside = np.cumsum(tokens == EDGE), tokens != EDGE
                    tokens, doc = tokens[inside], doc[inside]
                    pick = np.flatnonzero(mix(np.arange(len(tokens), dtype=np.uint64) * np.uint64(31) + tokens.astype(np.uint64)) % np.uint64(masked) == turn % masked)
                    t, w = tokens[pick], _windows(tokens, doc, pick)
                    words += len(t)
                    rest_t, rest_w = np.concatenate([*rest_t, t]) if len(rest_t) else t, np.concatenate([*rest_w, w]) if len(rest_w) else w
                    whole = len(rest_t) // batch_words * batch_words
                    for a in range(0, whole, batch_words):
                        mine.learn(rest_t[a:a + batch_words], rest_w[a:a + batch_words], rate)
                    rest_t, rest_w = [rest_t[whole:]], [rest_w[whole:]]
            if len(rest_t) and len(rest_t[0]):
                mine.learn(rest_t[0], rest_w[0], rate)
            if words:
                flat = mine.flat() * np.float32(1.0)
                cuts = range(0, len(flat), slice_of)
                yield pa.RecordBatch.from_pydict({"part": pa.array(list(range(len(cuts))), pa.int32()), "words": pa.array([float(words)] * len(cuts)),
                                                  "w": pa.array([flat[a:a + slice_of] for a in cuts], pa.list_(pa.float32()))})

        def average(batches):
            sums, words = {}, {}
            for batch in batches:
                part, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, p in enumerate(part):
                    v = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(float) * n[i]
                    sums[p], words[p] = sums.get(p, 0) + v, words.get(p, 0.0) + n[i]
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "words": pa.array(list(words.values()), pa.float64()),
                                              "w": pa.array([(sums[p] / words[p]).astype(np.float32) for p in sums], pa.list_(pa.float32()))})

        schema = "part int, words double, w array<float>"
        copies = texts.mapInArrow(train, schema)
        # sums of neighbouring copies first, then all: no task reads a slice from every partition
        some = copies.repartition(F.col("part"), F.pmod(F.hash(F.element_at("w", 1), "words"), F.lit(16))).mapInArrow(average, schema)
        whole = land(some.repartition("part").mapInArrow(average, schema), "lm-network").toPandas().sort_values("part")
        if not len(whole):
            break
        net.load(np.concatenate([np.asarray(v, np.float32) for v in whole["w"]]))
        start.unpersist()
    return net


def score(docs: DataFrame, net: Network, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (``text`` on request) with ``n_words``, ``log_likelihood`` (sum over all words of the log-probability
    given both sides) and ``mean_log_likelihood`` (null without words).  Null and empty texts have 0 words and sum 0.  Columns of
    these names are replaced.

    p(word | both sides) = p(bucket | both sides) * p(word | bucket).  A word seen n times in a bucket of N words has
    p(word | bucket) = n / (N + 1); what is left, 1 / (N + 1), is that of every word not seen.  Words of at least 1 / COMMON of the
    corpus are looked up where the text is, all others are joined with the table of words.  A network without that table
    (not from ``fit``) has seen no words.
    """
    spark = docs.sparkSession
    words = net.words if net.words is not None else spark.createDataFrame([], "h long, n long")
    many = max(net.totals.sum() / COMMON, 1.0)
    common = words.where(F.col("n") >= many).toPandas().sort_values("h")
    model = spark.sparkContext.broadcast((net, common["h"].to_numpy(np.int64), np.log(common["n"].to_numpy(float))))

    @F.arrow_udf("struct<n:bigint,total:double,rare:array<bigint>>")
    def likelihood(texts: pa.Array) -> pa.Array:
        network, known, log_n = model.value
        rest = np.log(network.totals + 1)
        n, total, rare, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts)), [], np.zeros(len(texts) + 1, np.int64)
        for c, hashes in _words(texts):
            n[c.first:c.first + c.n] = c.counts
            if len(hashes):
                tokens, h = _bucket(hashes), hashes.view(np.int64)
                value = network.log_probability(tokens, _windows(tokens, c.doc)) - rest[tokens]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(len(h), np.int64)
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                value[hit] += log_n[at[hit]]
                total[c.first:c.first + c.n] = np.bincount(c.doc, weights=value, minlength=c.n)
                rare.append(h[~hit])
                sizes[c.first + 1:c.first + c.n + 1] = np.bincount(c.doc[~hit], minlength=c.n)
        flat = pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)], names=["n", "total", "rare"])

    new = free_name(docs, "_lm")
    row, more = free_name(docs, "_lm_row"), free_name(docs, "_lm_more")
    part = docs.withColumn(new, likelihood(F.col(text))).withColumn(row, F.monotonically_increasing_id())
    part = land(part if keep_text else part.drop(text), "lm-scored")
    rare = part.select(row, F.explode(F.col(f"{new}.rare")).alias("h")).groupBy(row, "h").agg(F.count(F.lit(1)).alias("k"))
    # a word that is not in the table counts as one more of its bucket: log 1
    seen = rare.join(words, "h").groupBy(row).agg(F.sum(F.col("k") * F.log("n")).alias(more))
    out = part.join(seen, row, "left")
    out = out.withColumn("n_words", F.col(f"{new}.n")).withColumn("log_likelihood", F.col(f"{new}.total") + F.coalesce(more, F.lit(0.0)))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))).drop(new, row, more)
