"""Language of texts and of the spans inside them: script ranges, letter n-grams per word, Viterbi over words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name
from .textvec import LETTER, lower_ascii, mix, text_chunks

BITS = 17
ORDERS = (1, 2, 3, 4)
#: First and last code point of the blocks a letter's script is read from.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = ("other", *SCRIPTS)
_edges = sorted((lo, hi + 1, NAMES.index(n)) for n, spans in SCRIPTS.items() for lo, hi in spans)
_bounds = np.array([x for lo, hi, _ in _edges for x in (lo, hi)])
_kinds = np.array([x for _, _, k in _edges for x in (k, 0)])


def _script_of(code: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_bounds, code, "right") - 1
    return np.where(at >= 0, _kinds[np.maximum(at, 0)], 0)


def _first_code(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code point of the UTF-8 sequence that starts at each position."""
    b = [buf[np.minimum(at + k, len(buf) - 1)].astype(np.int64) for k in range(4)]
    two, three = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    return np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)


class Words:
    """Words of a chunk and its distinct ones: ``unique`` indexes one occurrence each, ``of`` maps words to them."""

    def __init__(self, chunk):
        chunk.split(LETTER)
        self.low = lower_ascii(chunk.buf)
        chunk.prefix_hash(self.low)
        _, self.unique, self.of = np.unique(chunk.word_hashes(), return_index=True, return_inverse=True)
        self.start, self.end = chunk.start[self.unique], chunk.end[self.unique]
        self.script = _script_of(_first_code(chunk.buf, self.start)) if len(self.start) else np.zeros(0, np.int64)

    def grams(self, order: int):
        """Bucket of every byte n-gram of every distinct word, a blank before and behind it, and the word of each."""
        length = self.end - self.start + 2
        flat_at = np.concatenate([[0], np.cumsum(length)])
        flat = np.full(flat_at[-1], 32, np.uint64)
        body = np.repeat(self.start - flat_at[:-1] - 1, length) + np.arange(flat_at[-1])
        inner = np.ones(flat_at[-1], bool)
        inner[flat_at[:-1]] = False
        inner[flat_at[1:] - 1] = False
        flat[inner] = self.low[body[inner]]
        word = np.repeat(np.arange(len(length)), length)
        m = len(flat) - order + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.full(m, order, np.uint64)
        for k in range(order):
            code = code << np.uint64(8) | flat[k:m + k]
        same = word[:m] == word[order - 1:]
        return (mix(code[same]) >> np.uint64(64 - BITS)).astype(np.int64), word[:m][same]


class Model:
    """Log-likelihoods of letter n-grams per language, and the scripts each language is written in."""

    def __init__(self, langs, counts, scripts):
        self.langs = langs
        # an unseen n-gram costs the same in every language of like size; orders share one table
        smooth = 0.5
        totals = counts.sum(1, keepdims=True)
        self.log = np.log((counts + smooth) / (totals + smooth * counts.shape[1])).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share >= 0.01
        allowed[:, ~allowed.any(0)] = True  # a script no language uses narrows nothing
        self.allowed = allowed.T

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.unique), len(self.langs)))
        for order in ORDERS:
            bucket, word = words.grams(order)
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(word, weights=self.log[bucket, k], minlength=len(out))
        out /= len(ORDERS)
        return np.where(self.allowed[words.script], out, -1e6)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out=None, sample: int = 24_000, seed: int = 7) -> Model | None:
    """Learn from a sample of about ``sample`` rows (that bound is a parameter), drawn by a hash of key and text over the whole
    table.  Rows without language or text teach nothing; ``held_out`` is a condition on the key no training row may meet.
    None when nothing can be learned."""
    usable = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    if held_out is not None:
        usable = usable.where(~F.coalesce(held_out(F.col("_key")), F.lit(False)))
    sizes = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    langs = sorted(sizes)
    # a language with few rows is taken whole, so that none goes unlearned
    fair = sample / len(langs)
    rate = F.lit(1.0)
    for name in langs:
        rate = F.when(F.col("_lang") == name, F.lit(min(1.0, fair / sizes[name]))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(seed), "_key", "_text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = usable.where(draw < rate).select("_lang", "_text")

    def count(batches):
        grams, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(NAMES)))
        number = {name: i for i, name in enumerate(langs)}
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for c in text_chunks(batch.column(1)):
                w = Words(c)
                if not len(w.unique):
                    continue
                lang_of = of[c.first + c.doc]
                for k in range(len(langs)):
                    mine = lang_of == k
                    weight = np.bincount(w.of[mine], minlength=len(w.unique)).astype(float)
                    scripts[k] += np.bincount(w.script, weights=weight, minlength=len(NAMES))
                    for order in ORDERS:
                        bucket, word = w.grams(order)
                        grams[k] += np.bincount(bucket, weights=weight[word], minlength=1 << BITS)
        for k in range(len(langs)):
            both = np.concatenate([grams[k], scripts[k]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(at), k), pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(both[at])})

    total = chosen.mapInArrow(count, "lang int, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()  # at most languages x 2**BITS
    table = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
    table[total["lang"], total["at"]] = total["n"]
    return Model(langs, table[:, :1 << BITS], table[:, 1 << BITS:])


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: per text the labels that maximise the scores minus ``penalty`` per change.

    All texts advance together, the longest first, so a step is one numpy operation over the texts still running.
    """
    n, k = scores.shape
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, length = offsets[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")  # texts with at least t + 1 words
    back = np.zeros((n, k), np.int16 if k > 120 else np.int8)
    best = np.zeros((len(length), k))
    stay = np.arange(k)
    for t, a in enumerate(active):
        at = begin[:a] + t
        if t:
            top = best[:a].argmax(1)
            switch = best[np.arange(a), top] - penalty
            change = switch[:, None] > best[:a]
            back[at] = np.where(change, top[:, None], stay)
            best[:a] = np.where(change, switch[:, None], best[:a])
        best[:a] += scores[at]
    label = np.zeros(n, np.int64)
    if len(active):
        now = best.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            label[at] = now[:a]
            now[:a] = back[at, now[:a]]
    return label


def _no_letter(text) -> bool:
    return text is None or not any(ch.isalpha() for ch in text)


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model | None, text: str = "text", penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and, if asked, ``spans`` (bytes of the UTF-8 text, end exclusive).

    A word's script leaves the languages written in it; the likelihoods of its letter n-grams score those; Viterbi labels
    the words with ``penalty`` (nats) for each change of language, and equal labels in a row make a span.  The text gets
    the language with most letters (the smaller name among equals), ``score`` is that language's share of the letters.
    A null text, or one without any letter, is ``und`` with score 0 and has no spans, as is every text when there is no model.
    Columns of the result's names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"struct<lang:string,score:double,spans:{SPANS}>" if spans else "struct<lang:string,score:double>"

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        model = shared.value
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        marked = [[] for _ in range(len(texts))]
        for c in text_chunks(texts, 4 << 20) if model is not None else ():  # texts that advance together
            w = Words(c)
            if not len(w.unique):
                continue
            got = viterbi(model.word_scores(w)[w.of], c.word_offsets, penalty)
            letters = np.zeros((c.n, len(model.langs)))
            np.add.at(letters, (c.doc, got), (c.end - c.start).astype(float))
            top, total = letters.argmax(1), letters.sum(1)
            ascii_letter = np.bincount(c.doc[c.buf[c.start] < 128], minlength=c.n) > 0
            for i in np.flatnonzero(total > 0):
                if ascii_letter[i] or not _no_letter(texts[c.first + i].as_py()):
                    langs[c.first + i], scores[c.first + i] = model.langs[top[i]], letters[i, top[i]] / total[i]
            if spans:
                new = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1]) | (c.doc[1:] != c.doc[:-1])]))
                last = np.append(new[1:], len(got)) - 1
                for a, b in zip(new, last, strict=True):
                    i = c.first + c.doc[a]
                    if langs[i] != "und":
                        base = c.offsets[c.doc[a]]
                        marked[i].append({"start": int(c.start[a] - base), "end": int(c.end[b] - base), "lang": model.langs[got[a]]})
        out = {"lang": pa.array(langs, pa.string()), "score": pa.array(scores)}
        if spans:
            out["spans"] = pa.array(marked, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    new = free_name(docs, "_label")
    named = docs.withColumn(new, label(F.col(text)))
    named = named.withColumn("lang_pred", F.col(f"{new}.lang")).withColumn("score", F.col(f"{new}.score"))
    return (named.withColumn("spans", F.col(f"{new}.spans")) if spans else named).drop(new)
