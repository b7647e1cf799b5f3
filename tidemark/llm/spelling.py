"""Spelling variants: words one letter apart, found in a trie of letter-group counts, each below its most frequent form."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import land

GROUPS = 32             # a letter belongs to the group code point modulo 32
LEVELS = 4              # of the trie that deal words to tasks
FULL = 255              # counts beyond share a branch of these levels
LEAF = 8                # words that are compared without going deeper
PAIRS = 4096            # or so many pairs of words and askers
COMPARED = 1 << 22      # letters and counts that are compared at once
DATA_LETTERS = 400_000  # in the words of one trie
QUERY_LETTERS = 2_000_000


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length."""
    return np.array(words, dtype=f"U{max(1, length)}").view(np.uint32).reshape(len(words), -1)[:, :length]


def _counts(words: list[str]) -> np.ndarray:
    """How often each letter group stands in each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(words)), lengths) * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _moves(levels: int) -> list[tuple[int, np.ndarray]]:
    """What one inserted, deleted or replaced letter can change: the length, and the first counts of the vector."""
    unit, none = np.eye(levels, dtype=np.int64), np.zeros(levels, np.int64)
    replaced = [none, *unit, *-unit, *(unit[i] - unit[j] for i in range(levels) for j in range(levels) if i != j)]
    return [(0, m) for m in replaced] + [(1, m) for m in (none, *unit)] + [(-1, m) for m in (none, *-unit)]


def _cells(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Branch of the first levels: the length and the first counts in one number."""
    cell = lengths.astype(np.int64)
    for column in counts.T:
        cell = cell << 8 | np.minimum(column, FULL)
    return cell


def _routes(order: list[int], words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Role (0: in the trie, 1: asks), cells and positions of words: each stands in one cell and asks in all that one edit reaches."""
    counts, lengths = _counts(words)[:, order[:LEVELS]], np.fromiter(map(len, words), np.int64, len(words))
    yield 0, _cells(counts, lengths), np.arange(len(words))
    asked = []
    for longer, move in _moves(LEVELS):
        to = counts + move
        at = np.flatnonzero((to >= 0).all(1) & (to.sum(1) <= lengths + longer) & (lengths + longer > 0))
        asked.append(np.stack([_cells(to[at], lengths[at] + longer), at], 1))
    once = np.unique(np.concatenate(asked), axis=0)
    yield 1, once[:, 0], once[:, 1]


class CountTrie:
    """Words of one length, sorted by their letter-group counts: a node of level l is a run of words with equal counts of the first l groups."""

    def __init__(self, words: list[str], order: list[int]):
        length = len(words[0])
        counts = _counts(words)[:, order]
        at = np.lexsort(counts.T[::-1])
        self.words, self.order, self.length = [words[i] for i in at], order, length
        self.counts, self.letters = counts[at], _letters(self.words, length)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in ``words``, position in the trie) that are one edit apart; ``words`` have one length, at most one off the trie's."""
        self.asked, self.asked_letters, self.out = _counts(words)[:, self.order], _letters(words, len(words[0])), []
        longer = self.length - len(words[0])
        who = np.arange(len(words))
        budget = np.ones(len(words), bool)
        self._descend(0, 0, len(self.words), who, budget if longer >= 0 else ~budget, budget if longer <= 0 else ~budget)
        if not self.out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.out, strict=True))

    def _descend(self, level: int, a: int, b: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Depth first, all askers of a node together: a branch that has one more or one less of a group spends the budget of one each."""
        if b - a <= LEAF or (b - a) * len(who) <= PAIRS or level == GROUPS:
            self._verify(level, a, b, who, surplus, deficit)
            return
        column = self.counts[a:b, level]
        cuts = (a + 1 + np.flatnonzero(column[1:] != column[:-1])).tolist()
        own = self.asked[who, level]
        for start, end in zip([a, *cuts], [*cuts, b], strict=True):
            more = self.counts[start, level] - own
            go = (more == 0) | ((more == 1) & surplus) | ((more == -1) & deficit)
            if go.any():
                more = more[go]
                self._descend(level + 1, start, end, who[go], surplus[go] & (more != 1), deficit[go] & (more != -1))

    def _verify(self, level: int, a: int, b: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """The words of a leaf: the rest of the vectors first, then the letters."""
        step = max(1, COMPARED // ((b - a) * max(self.length, GROUPS)))
        for at in range(0, len(who), step):
            few = who[at:at + step]
            left, right = np.repeat(few, b - a), np.tile(np.arange(a, b), len(few))
            if level < GROUPS:
                more = (self.counts[a:b, level:] - self.asked[few, None, level:]).reshape(len(left), -1)
                moved, grown = np.abs(more).sum(1), more.sum(1)  # twice the surplus is their sum, twice the deficit their difference
                fits = (moved + grown <= 2 * np.repeat(surplus[at:at + step], b - a)) & (moved - grown <= 2 * np.repeat(deficit[at:at + step], b - a))
                left, right = left[fits], right[fits]
            x, y = self.asked_letters[left], self.letters[right]
            if x.shape[1] == y.shape[1]:
                near = (x != y).sum(1) == 1
            else:
                if x.shape[1] > y.shape[1]:
                    x, y = y, x
                short = x.shape[1]
                front = np.logical_and.accumulate(x == y[:, :short], 1).sum(1)
                back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
                near = front + back >= short
            if near.any():
                self.out.append((left[near], right[near]))


def _answers(trie_words: list[str], trie_n: list[int], askers: list[str], order: list[int]) -> pa.RecordBatch | None:
    """Per asker with near words: how many, and the first by falling n, then code points."""
    ranked = sorted(range(len(trie_words)), key=lambda i: (-trie_n[i], trie_words[i]))
    place = {trie_words[i]: r for r, i in enumerate(ranked)}
    trie = CountTrie(trie_words, order)
    rank = np.array([place[w] for w in trie.words])
    words, counts, firsts = [], [], []
    for length in {len(w) for w in askers}:
        some = [w for w in askers if len(w) == length]
        left, right = trie.near(some)
        count, first = np.zeros(len(some), np.int64), np.full(len(some), len(trie_words))
        np.add.at(count, left, 1)
        np.minimum.at(first, left, rank[right])
        for i in np.flatnonzero(count):
            words.append(some[i])
            counts.append(int(count[i]))
            firsts.append(ranked[first[i]])
    if not words:
        return None
    return pa.RecordBatch.from_pydict({"word": words, "n_near": pa.array(counts, pa.int64()), "best_n": pa.array([trie_n[i] for i in firsts], pa.int64()), "best": [trie_words[i] for i in firsts]})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Words with others one inserted, deleted or replaced code point away: word, ``n_near``, ``best`` and ``best_n`` (the near word of
    largest n, of equal ones the first by code points).

    ``vocabulary`` has distinct words and their n.  A word is the vector of its letter-group counts, groups ordered by how
    often their letters stand in the vocabulary.  The first levels of the trie, with the length, deal the words to tasks: each word
    stands in one cell and asks in those that one edit reaches (31 at most; cells without words are dropped before the words
    move).  A cell beyond ``DATA_LETTERS`` or ``QUERY_LETTERS`` is cut into blocks that meet each other in tasks of their own; a
    task holds one block of a cell.  Below, the trie is searched depth first with a budget of one surplus and one deficit.  Only
    counts and the best word leave a task, never pairs.
    """
    def totals(batches):
        total = np.zeros(GROUPS, np.int64)
        for batch in batches:
            total += _counts(batch.column("word").to_pylist()).sum(0)
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(GROUPS), pa.int32()), "total": total})

    total = dict(vocabulary.select("word").mapInArrow(totals, "g int, total long").groupBy("g").agg(F.sum("total")).collect())
    order = sorted(range(GROUPS), key=lambda g: (-total.get(g, 0), g))

    def routes(batches):
        for batch in batches:
            if batch.num_rows:
                for role, cells, at in _routes(order, batch.column("word").to_pylist()):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_pydict({"cell": cells, "role": pa.array(np.full(len(at), role, np.int32)), "word": rows.column("word"), "n": rows.column("n")})

    routed = vocabulary.select("word", "n").mapInArrow(routes, "cell long, role int, word string, n long")
    sizes = routed.groupBy("cell").agg(F.sum(1 - F.col("role")).alias("data"), F.sum("role").alias("asks")).where("data > 0")
    length = F.shiftright("cell", 8 * LEVELS)
    blocks = lambda rows, most: F.ceil(F.col(rows) * length / F.lit(most)).cast("int")
    sizes = land(sizes.select("cell", F.greatest(blocks("data", DATA_LETTERS), F.lit(1)).alias("tries"), F.greatest(blocks("asks", QUERY_LETTERS), F.lit(1)).alias("asks")), "spell-cells")
    here = lambda many: F.pmod(F.xxhash64("word"), F.col(many)).cast("int")
    every = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    met = routed.join(sizes, "cell")
    met = met.withColumn("i", F.explode(F.when(F.col("role") == 0, F.array(here("tries"))).otherwise(every("tries")))).withColumn("j", F.explode(F.when(F.col("role") == 1, F.array(here("asks"))).otherwise(every("asks"))))
    dealt = met.select("cell", "i", "j", "role", "word", "n").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "role")

    def search(batches):
        task, words, n, askers = None, [], [], []
        for batch in batches:
            cells, i, j, role = (batch.column(c).to_numpy() for c in ("cell", "i", "j", "role"))
            if not len(cells):
                continue
            all_words, all_n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            cut = np.flatnonzero((cells[1:] != cells[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(cells)], strict=True):
                if (cells[a], i[a], j[a]) != task:
                    if words and askers and (out := _answers(words, n, askers, order)):
                        yield out
                    task, words, n, askers = (cells[a], i[a], j[a]), [], [], []
                first = a + int(np.searchsorted(role[a:b], 1))
                words += all_words[a:first]
                n += all_n[a:first]
                askers += all_words[first:b]
        if words and askers and (out := _answers(words, n, askers, order)):
            yield out

    found = dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms: word, root.  ``forms`` has word and form, chains without circles.

    Pointers are doubled, so a chain of length l takes log2(l) joins; each round is written.  A root with very many words is one row
    of the side that is looked up, the other side is split by adaptive execution.
    """
    now = land(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        later = land(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spell-roots")
        now = later.select("word", "root")
        if later.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, word: str = "word", least_letters: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """Distinct words with their counts and forms: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has a row per occurrence.  Words of at least ``least_letters`` code points and ``least_count`` occurrences are kept;
    two are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is its near word of
    largest n (ties: first by code points) if that n is at least ``times`` (over 1) its own, else null; root is where the chain of
    forms ends, the word itself without one.  Upper and lower case are different letters here.

    Null and empty words are left out; very long words are words like any other; repeats are what is counted; other columns are not
    read.  An empty table gives no rows.
    """
    counted = words.select(F.col(word).alias("word")).where(F.length("word") >= max(1, least_letters)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    vocabulary = land(counted, "spell-words")
    stats = near_words(vocabulary)
    above = F.col("best_n") >= F.lit(times) * F.col("n")
    formed = vocabulary.join(stats, "word", "left").select("word", F.when(above, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(above, F.col("best_n")).alias("form_n"))
    formed = land(formed, "spell-forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, least_letters: int = 5) -> DataFrame:
    """Runs of Latin letters of whole texts, A-Z lower-cased, with misspellings by rule: ``word``, a row per run of at least ``least_letters``.

    Where ``every`` divides h, the unsigned crc32 of ``<key>:<run>``, the code point at h % length is left out.  Null texts have no
    runs; where the key is null nothing is left out.
    """
    least = lambda r: F.length(r) >= least_letters
    runs = docs.select(F.col(key).cast("string").alias("_key"), F.explode(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-zÀ-ÿ]+"), least)).alias("raw"))
    plain = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = F.crc32(F.encode(F.concat("_key", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    return runs.select("_key", plain.alias("run")).select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
