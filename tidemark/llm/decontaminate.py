"""Benchmark decontamination: a BM25 index of test items with block-max pruning, queried by every passage."""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, land
from .textvec import WORD, lower_ascii, ngram_hashes, text_chunks

BLOCK = 8       # items per block of a posting list
GRAM = 4        # words in a row that must agree when a hit is verified
BITS = 22


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; a single sentence is cut in the middle of its words."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s|$)", text)]
    cut = max((e for e in ends if text[e:].strip()), default=None)
    if cut is None:
        words = text.split()
        return " ".join(words[:(len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2:])
    return text[:cut], text[cut:]


def _words(texts: list[str]):
    hashes, docs = [], []
    for c in text_chunks(pa.array(texts, pa.string())):
        c.split(WORD)
        c.prefix_hash(lower_ascii(c.buf))
        hashes.append(c.word_hashes())
        docs.append(c.doc + c.first)
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ranges(first, last):
    """All numbers of the ranges in a row, and which range each one belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), of


@dataclass
class Corpus:
    """What all items of the benchmark say, in whatever parts they are indexed: scores and passages depend on nothing else."""

    items: int
    worded: int              # items with words
    words: int
    longest: int             # words of the longest item
    terms: np.ndarray        # sorted word hashes, those of a part at least
    holders: np.ndarray      # items that hold the term


@dataclass
class Index:
    """Postings of the items, sorted by term, then item; items are numbered in blocks of BLOCK.

    Impacts are BM25 contributions divided by the score the item gives itself, so one threshold in (0, 1] serves all.
    """

    ids: np.ndarray
    terms: np.ndarray        # sorted word hashes
    first: np.ndarray        # postings of a term: first[t] to first[t + 1]
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # blocks of a term's list: block_first[t] to block_first[t + 1]
    block: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    filter: np.ndarray
    grams: list              # per item: distinct n-grams of question and of answer
    stride: int

    @classmethod
    def build(cls, ids, texts, corpus=None, k1=1.2, b=0.75):
        """``corpus``: what the whole benchmark says, where ``texts`` are a part of it; see ``Corpus``."""
        h, d = _words(texts)
        n = len(texts)
        length = np.bincount(d, minlength=n).astype(float)
        terms, t = np.unique(h, return_inverse=True)
        pair, tf = np.unique(t.astype(np.int64) * max(n, 1) + d, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        if corpus is None:
            corpus = Corpus(n, int((length > 0).sum()), int(length.sum()), int(length.max() if n else 0), terms, np.bincount(term, minlength=len(terms)))
        df = corpus.holders[np.searchsorted(corpus.terms, terms)]
        idf = np.log(1 + (corpus.items - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * length / max(corpus.words / max(corpus.worded, 1), 1.0))
        gain = idf[term] * tf * (k1 + 1) / (tf + norm[item])
        impact = gain / np.bincount(item, weights=gain, minlength=n)[item]
        # a list's blocks are the numbers of BLOCK items in a row
        key = term * (n // BLOCK + 1) + item // BLOCK
        blocks, at = np.unique(key, return_index=True)
        block_max = np.maximum.reduceat(impact, at) if len(at) else np.zeros(0)
        bterm = blocks // (n // BLOCK + 1)
        bounds = np.arange(len(terms) + 1)
        first, bfirst = np.searchsorted(term, bounds), np.searchsorted(bterm, bounds)
        term_max = np.maximum.reduceat(impact, first[:-1]) if len(terms) else np.zeros(0)
        flt = np.zeros(1 << BITS, bool)
        flt[(terms >> np.uint64(64 - BITS)).astype(np.int64)] = True
        grams = []
        for x in texts:
            sides = []
            for side in parts_of(x):
                w, _ = _words([side])
                size = min(GRAM, len(w))
                sides.append((np.unique(ngram_hashes(w, np.zeros(len(w), np.int64), size)[0]) if size else np.zeros(0, np.uint64), size))
            grams.append(sides)
        return cls(np.asarray(ids, np.int64), terms, first, item, impact, bfirst, blocks % (n // BLOCK + 1), block_max, term_max, flt, grams, max(corpus.longest, 8))

    def lookup(self, words):
        """Term number of every word, -1 for words of no item."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(words >> np.uint64(64 - BITS)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == words[maybe], at, -1)
        return out

    def search(self, window, term, threshold):
        """All (window, item, score) with score >= threshold, from distinct (window, term) pairs sorted by window.

        First the blocks: the sum of the best impacts that a block of items holds for the window's terms bounds the score
        of each item in it.  Only blocks that reach the threshold are opened and their postings added up.
        """
        at, of = _ranges(self.block_first[term], self.block_first[term + 1])
        blocks = int(self.block.max()) + 1 if len(self.block) else 1
        key, inv = np.unique(window[of] * blocks + self.block[at], return_inverse=True)
        opened = np.bincount(inv, weights=self.block_max[at], minlength=len(key)) >= threshold - 1e-9
        keep = opened[inv]
        w, t, b = window[of][keep], term[of][keep], self.block[at][keep]
        post, of = _ranges(self.first[t], self.first[t + 1])
        mine = self.item[post] // BLOCK == b[of]
        post, of = post[mine], of[mine]
        n = len(self.ids)
        key, inv = np.unique(w[of] * n + self.item[post], return_inverse=True)
        total = np.bincount(inv, weights=self.impact[post], minlength=len(key))
        good = total >= threshold - 1e-9
        return key[good] // n, key[good] % n, total[good]


def _hits(index: Index, texts, threshold, overlap):
    """Per batch: text number, item number, score, shares of the question's and the answer's word n-grams found."""
    for c in text_chunks(texts):
        c.split(WORD)
        c.prefix_hash(lower_ascii(c.buf))
        words = c.word_hashes()
        term = index.lookup(words)
        # passages: 2 * stride words every stride words, so an item lies whole in one of them
        per_doc = np.maximum(-(-c.counts // index.stride) - 1, (c.counts > 0).astype(np.int64))
        k, doc = _ranges(np.zeros(c.n, np.int64), per_doc)
        begin = c.word_offsets[doc] + k * index.stride
        end = np.minimum(begin + 2 * index.stride, c.word_offsets[doc + 1])
        if not len(begin):
            continue
        # a passage whose terms' best impacts add up to less than the threshold can't reach it
        best = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, index.term_max[term], 0.0) if len(index.term_max) else np.zeros(len(term)))])
        live = np.flatnonzero(best[end] - best[begin] >= threshold - 1e-9)
        if not len(live):
            continue
        at, of = _ranges(begin[live], end[live])
        known = term[at] >= 0
        pair = np.unique(of[known] * max(len(index.terms), 1) + term[at[known]])
        window, t = pair // max(len(index.terms), 1), pair % max(len(index.terms), 1)
        again = np.bincount(window, weights=index.term_max[t], minlength=len(live)) >= threshold - 1e-9  # repeats count once
        window, t = window[again[window]], t[again[window]]
        if not len(window):
            continue
        w, item, score = index.search(window, t, threshold)
        seen = {}
        for x, i, s in zip(live[w], item, score, strict=True):
            d = doc[x]
            # verify on the passage and the words around it, in which a cut n-gram would go on
            a, b = max(begin[x] - GRAM, c.word_offsets[d]), min(end[x] + GRAM, c.word_offsets[d + 1])
            found = []
            for grams, size in index.grams[i]:
                got = ngram_hashes(words[a:b], c.doc[a:b], size)[0] if size else grams
                found.append(float(np.isin(grams, got).mean()) if len(grams) else None)
            q, ans = found
            if all(v is None or v >= overlap for v in found):
                old = seen.get((d, i))
                if old is None or s > old[0]:
                    seen[d, i] = (float(s), q, ans)
        for (d, i), v in seen.items():
            yield c.first + d, i, *v


HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def _finder(shared, threshold: float, overlap: float):
    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        index, missing = shared.value
        lists = [None] * len(texts)
        for d, i, s, q, a in _hits(index, texts, threshold, overlap):
            lists[d] = (lists[d] or []) + [{"item_id": None if missing[i] else int(index.ids[i]), "score": s, "question_overlap": q, "answer_overlap": a}]
        kind = pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])
        return pa.array(lists, pa.list_(kind))
    return find


def _item_terms(items: DataFrame) -> DataFrame:
    """The distinct words of every item of column t, by their hash: h."""
    def terms(batches):
        for batch in batches:
            for c in text_chunks(batch.column(0)):
                c.split(WORD)
                c.prefix_hash(lower_ascii(c.buf))
                h = c.word_hashes()
                order = np.lexsort((h, c.doc))
                h, doc = h[order], c.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[new].view(np.int64), pa.int64())})
    return items.select("t").mapInArrow(terms, "h long")


def _item_lengths(items: DataFrame) -> DataFrame:
    """The number of words of every item of column t: n."""
    def lengths(batches):
        for batch in batches:
            for c in text_chunks(batch.column(0)):
                c.split(WORD)
                yield pa.RecordBatch.from_pydict({"n": pa.array(c.counts, pa.int64())})
    return items.select("t").mapInArrow(lengths, "n long")


def finders(benchmark: DataFrame, item: str, item_text: str, threshold: float, overlap: float, index_bytes: int) -> list:
    """A function per part of the benchmark that maps a text column to its hits; a part holds at most about ``index_bytes`` of text.

    Document frequencies, the number of items, their mean length and the length of passages are those of the whole benchmark, counted
    by Spark, so that the hits do not depend on the parts.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // index_bytes))
    if parts > 1:  # one part is the whole benchmark and counts itself
        holders = land(_item_terms(items).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "leak-terms")
        facts = _item_lengths(items).agg(F.count(F.lit(1)), F.count_if(F.col("n") > 0), F.sum("n"), F.max("n")).first()
    out = []
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        rows = sorted(mine.collect(), key=lambda r: (r["i"] is None, r["i"], r["t"]))  # bounded by index_bytes
        corpus = None
        if parts > 1:
            # the terms of this part alone come to the driver: they are bounded with its text
            known = holders.join(_item_terms(mine).distinct(), "h", "left_semi").toPandas()
            terms = known["h"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(terms)
            corpus = Corpus(*map(int, facts), terms[order], known["n"].to_numpy(np.int64)[order])
        index = Index.build([-1 if r["i"] is None else r["i"] for r in rows], [r["t"] for r in rows], corpus)
        shared = spark.sparkContext.broadcast((index, np.array([r["i"] is None for r in rows], bool)))
        out.append(_finder(shared, threshold, overlap))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5,
                 index_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` that hold a test item: key, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``.

    Every passage of every text queries the index.  ``score`` is BM25 relative to the item's own score; items at or above
    ``threshold`` are verified: at least ``overlap`` of the n-grams (four words; fewer in a shorter part) of the question and of the
    answer must stand in the passage.  The best passage of a text speaks for it.

    The index is broadcast in parts of at most ``index_bytes`` of item text: one part for most benchmarks, more for larger
    ones, each a pass over the texts; scores and hits are the same for any number of parts.  Null and empty texts hold nothing; items without
    words match nothing; a null item id is kept as null.  Rows with the same key are searched one by one, and items repeated
    in the benchmark are reported each.  Without items or texts there are no rows.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    whole = None
    for find in finders(benchmark, item, item_text, threshold, overlap, index_bytes):
        part = slim.select("_key", find("_text").alias("hits")).select("_key", F.explode("hits").alias("h")).select(F.col("_key").alias(key), "h.*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5,
                         index_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no test item (as ``contaminated`` finds them), with all their columns and in place:
    no shuffle.  Null and empty texts stay."""
    for find in finders(benchmark, item, item_text, threshold, overlap, index_bytes):
        new = free_name(docs, "_hits")
        docs = docs.withColumn(new, find(F.col(text))).where(F.col(new).isNull()).drop(new)
    return docs
