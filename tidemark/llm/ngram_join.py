"""Exact Jaccard join of word n-gram sets by pigeonhole over a partitioned universe.

Sets of n shingles fall into size bands.  A band's universe is cut by hash into one more segments than two linked sets of
the band can differ by, so two linked sets agree on a segment.  A set is free to leave out segments it has to spare, and
one more for every segment it matches up to one deletion; it leaves out those with the longest lists.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import land
from .textvec import SPACE, lower_ascii, mix, ngram_hashes, text_chunks

SMALL = 8            # members of a segment list whose pairs are named at once
BLOCK = 384          # sets compared with each other in one task
FLUSH = 1 << 19      # segment entries a task gathers before it hands them on
WATCH = 20           # bits of the counter that tells long lists from short ones
LONG = 4             # entries seen in a task that make a list long
PROBE, INDEX = 1, 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts, n: int):
    """Per text (in order) the sorted distinct hashes of its n-word shingles; fewer words make one shingle of all of them."""
    for c in text_chunks(texts):
        c.split(~SPACE)
        c.prefix_hash(lower_ascii(c.buf))
        words = c.word_hashes()
        h, d = ngram_hashes(words, c.doc, n)
        cut = np.searchsorted(d, np.arange(c.n + 1))
        for i in range(c.n):
            if c.counts[i] >= n:
                yield np.unique(h[cut[i]:cut[i + 1]])
            elif c.counts[i]:
                w = words[c.word_offsets[i]:c.word_offsets[i + 1]]
                yield ngram_hashes(w, np.zeros(len(w), np.int64), len(w))[0]
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets) -> np.ndarray:
    """One number per set, 0 for the empty one."""
    size = np.array([len(s) for s in sets], np.uint64)
    total = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    return np.where(size > 0, mix(total * ODD + size), 0).astype(np.uint64)


class Bands:
    """Size bands and segment counts for a threshold num/den: sets link when den * intersection >= num * union.

    Linked sets of sizes a and b differ in at most (a + b)(den - num) / (den + num) shingles, and the larger one lies in
    the band of the smaller or the next.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = np.array([1, 2], np.int64)  # first size of each band
        self._grow(1 << 12)

    def _grow(self, size):
        low = list(self.low)
        while low[-1] <= size * self.den // self.num + 1:
            low.append(max(low[-1] + 1, (low[-1] - 1) * self.den // self.num + 1))
        low.append(max(low[-1] + 1, (low[-1] - 1) * self.den // self.num + 1))
        self.low = np.array(low, np.int64)
        self.segments = self.gap(self.low[1:] - 1, self.low[1:] - 1) + 1

    def gap(self, a, b):
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: np.ndarray) -> np.ndarray:
        if len(size) and size.max() * self.den // self.num + 1 >= self.low[-2]:
            self._grow(int(size.max()))
        return np.searchsorted(self.low, size, "right") - 1


def spare_segments(segments):
    """The first segments of a set also list their one-deletion neighbours: two and one in 24."""
    return np.minimum(2 + segments // 24, segments)


def _entries(flat, owner, size, band, need, index: bool, counter):
    """Segment entries of many sets for one band each: key (flags in the two low bits) and number of the owning set.

    ``flat``: all shingles, ``owner``: number of the set of each; per set its band's segment count ``band[1]``, band number ``band[0]``,
    and ``need``, the number of agreements it must be able to miss plus one.
    """
    number, segments = band
    n = len(size)
    base = np.concatenate([[0], np.cumsum(segments)])
    seg = ((flat >> np.uint64(32)) * segments[owner].astype(np.uint64)) >> np.uint64(32)
    at = base[owner] + seg.astype(np.int64)
    total = int(base[-1])
    filled = np.bincount(at, minlength=total)
    low = np.bincount(at, weights=(flat & np.uint64(0xFFFFFFFF)).astype(float), minlength=total)
    high = np.bincount(at, weights=(flat >> np.uint64(32)).astype(float), minlength=total)
    sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    set_of = np.repeat(np.arange(n), segments)
    place = np.arange(total) - base[set_of]
    salt = (number[set_of].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) * ODD
    key = mix(sums + salt)
    slot = (key >> np.uint64(64 - WATCH)).astype(np.int64)
    length = counter[slot].astype(np.int64)
    np.add.at(counter, slot, 1)

    # allocation: leave out the longest lists, empty segments first, as far as spare segments and deletions allow
    slack = segments - need
    spare = place < spare_segments(segments)[set_of]
    usable = spare & (filled >= 2)
    room = np.bincount(set_of[usable], minlength=n)
    cost = np.where(filled == 0, 1 << 40, np.where(usable | (length < LONG), 0, length))
    if not index:  # a probing set may leave out any segments it has to spare
        cost = np.maximum(cost, np.where(usable, 0, 1))
    wanted = np.flatnonzero(cost > 0)
    wanted = wanted[np.lexsort((-cost[wanted], set_of[wanted]))]
    first = np.searchsorted(set_of[wanted], np.arange(n))
    rank = np.arange(len(wanted)) - first[set_of[wanted]]
    # what costs nothing to keep is only left out within the slack
    limit = np.where(cost[wanted] > 1, slack[set_of[wanted]] + room[set_of[wanted]], slack[set_of[wanted]])
    out = np.zeros(total, bool)
    out[wanted[rank < limit]] = True
    more = np.maximum(np.bincount(set_of[out], minlength=n) - slack, 0)
    turn = np.cumsum(usable) - usable  # usable segments before this one
    turn = turn - turn[base[:-1]][set_of]
    double = usable & (turn < more[set_of])

    probes = ~out & (need > 1)[set_of]
    keys, owners = [], []

    def add(k, o, flags):
        keys.append((k & ~np.uint64(3)) | flags.astype(np.uint64))
        owners.append(o)

    if index:
        add(key, set_of, INDEX + PROBE * probes)
    else:
        add(key[probes], set_of[probes], np.full(int(probes.sum()), PROBE))
    near = usable[at] if index else double[at]
    k = mix(sums[at[near]] - flat[near] + salt[at[near]])
    add(k, owner[near], (INDEX if index else 0) + PROBE * double[at[near]])
    return np.concatenate(keys), np.concatenate(owners)


def odd_sketch(h: np.ndarray) -> bytes:
    """Parities of hashed bits: two sketches differ in at most as many bits as the sets differ in shingles."""
    width = max(64, 1 << int(2 * len(h) - 1).bit_length()) if len(h) else 64
    width = min(width, 1 << 17)
    bit = (mix(h) >> np.uint64(20)).astype(np.int64) & (width - 1)
    return np.packbits(np.bincount(bit, minlength=width) & 1).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches of a smaller width: bit i and i + width share a parity.  The kept bits are the low ones of the number."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _bits_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Differing bits of each pair of sketches, folded to the smaller of the two widths."""
    la, lb = (np.diff(x.offsets_np) for x in (a, b))
    out = np.zeros(len(la), np.int64)
    for wa, wb in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        rows = np.flatnonzero((la == wa) & (lb == wb))
        x, y = (v.data_np[v.offsets_np[:-1][rows][:, None] + np.arange(w)] for v, w in ((a, wa), (b, wb)))
        w = min(wa, wb)
        out[rows] = np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum(1)
    return out


class _Binary:
    """Bytes and offsets of an Arrow binary column."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.offsets_np = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        self.data_np = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


PASS = "kind int, bucket int, blob binary, a long, b long, n int"


def _emit(n: int, num: int, den: int, buckets: int):
    """The map side: a row per document (kind 0) and blobs of segment entries per bucket (kind 1)."""
    def run(batches):
        bands, counter, seen = Bands(num, den), np.zeros(1 << WATCH, np.uint32), set()
        held_k, held_r, held = [], [], 0

        def flush():
            k, r = np.concatenate(held_k), np.concatenate(held_r)
            order = np.argsort(k)
            k, r = k[order], r[order]
            cut = np.searchsorted(((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            blobs = [k[cut[i]:cut[i + 1]].tobytes() + r[cut[i]:cut[i + 1]].tobytes() for i in full]
            m = len(full)
            for a in range(0, m, 512):
                part = blobs[a:a + 512]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int32)), pa.array(full[a:a + 512].astype(np.int32)), pa.array(part, pa.binary()), none, none, pa.nulls(len(part), pa.int32())],
                                                 names=["kind", "bucket", "blob", "a", "b", "n"])

        for batch in batches:
            ids = batch.column(0)
            sets, first = [], 0

            def handle(sets, first):
                nonlocal held
                size = np.array([len(s) for s in sets], np.int64)
                sig = signatures(sets)
                sketches = [odd_sketch(s) if len(s) else None for s in sets]
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int32)), pa.array((mix(sig + np.arange(len(sets), dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.array(sketches, pa.binary()), ids.slice(first, len(sets)).cast(pa.int64()),
                     pa.array(_signed(sig)), pa.array(size.astype(np.int32))], names=["kind", "bucket", "blob", "a", "b", "n"])
                new = [i for i in range(len(sets)) if size[i] and int(sig[i]) not in seen and not seen.add(int(sig[i]))]
                if new:
                    size, sig, picked = size[new], sig[new], [sets[i] for i in new]
                    band = bands.of(size)
                    for step in (0, 1):
                        b = band + step
                        if step == 0:
                            need = bands.gap(size, np.minimum(bands.low[b + 1] - 1, size * den // num)) + 1
                            go = np.flatnonzero(bands.segments[b] > 1)
                        else:
                            need = bands.gap(size, size * den // num) + 1
                            go = np.flatnonzero((size * den // num >= bands.low[b]) & (need > 1))
                        if not len(go):
                            continue
                        flat = np.concatenate([picked[i] for i in go])
                        owner = np.repeat(np.arange(len(go)), size[go])
                        k, o = _entries(flat, owner, size[go], (b[go], bands.segments[b[go]]), need[go], step == 0, counter)
                        held_k.append(k)
                        held_r.append(sig[go][o])
                        held += len(k)
                return rows

            words = 0
            for s in shingle_sets(batch.column(1), n):
                sets.append(s)
                words += len(s)
                if words >= 1 << 18:
                    yield handle(sets, first)
                    first, sets, words = first + len(sets), [], 0
                    if held >= FLUSH:
                        yield from flush()
                        held_k.clear(), held_r.clear()
                        held = 0
            if sets:
                yield handle(sets, first)
        if held:
            yield from flush()
    return run


def _match(batches):
    """The reduce side: documents pass through (kind 0), lists of up to SMALL sets become pairs (kind 2), longer lists a star of
    pairs around one of their sets and a row per member (kind 3: a = list, b = set, n = flags)."""
    blobs: dict[int, list] = {}
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        if (kinds == 0).any():
            yield batch.filter(pa.array(kinds == 0))
        for i in np.flatnonzero(kinds == 1):
            blobs.setdefault(batch.column(1)[i].as_py(), []).append(batch.column(2)[i].as_py())

    def rows(kind, a, b, n):
        m = len(a)
        for at in range(0, m, 1 << 16):
            s = slice(at, at + (1 << 16))
            c = len(a[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c, kind, np.int32)), pa.nulls(c, pa.int32()), pa.nulls(c, pa.binary()), pa.array(_signed(a[s])), pa.array(_signed(b[s])), pa.array(n[s].astype(np.int32))],
                                             names=["kind", "bucket", "blob", "a", "b", "n"])

    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for bucket in sorted(blobs):
        parts = blobs.pop(bucket)
        k = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16) for p in parts])
        r = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16, len(p) // 2) for p in parts])
        flag, k = (k & np.uint64(3)).astype(np.uint8), k >> np.uint64(2)
        order = np.argsort(k, kind="stable")
        twin = k[order]
        shared = np.zeros(len(k), bool)  # only lists with two entries or more go on
        same = twin[1:] == twin[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        k, r, flag = k[order], r[order], flag[order]
        order = np.lexsort((r, k))
        k, r, flag = k[order], r[order], flag[order]
        if not len(k):
            continue
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        at = np.flatnonzero(new)
        flag = np.bitwise_or.reduceat(flag, at)
        k, r = k[at], r[at]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.concatenate([first, [len(k)]]))
        # lists need a probing set and an indexed one
        any_of = np.bitwise_or.reduceat(flag, first)
        ok = (count > 1) & (any_of == 3)
        for c in range(2, SMALL + 1):
            f = first[ok & (count == c)]
            for x in range(c):
                for y in range(x + 1, c):
                    a, b = f + x, f + y
                    good = ((flag[a] & PROBE) > 0) & ((flag[b] & INDEX) > 0) | ((flag[b] & PROBE) > 0) & ((flag[a] & INDEX) > 0)
                    left.append(r[a[good]])
                    right.append(r[b[good]])
        big = np.flatnonzero(ok & (count > SMALL))
        if len(big):
            f, c = first[big], count[big]
            of = np.repeat(np.arange(len(big)), c)
            member = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + f[of]
            left.append(r[f[of]])
            right.append(r[member])
            yield from rows(3, k[member], r[member], flag[member])
    a, b = np.concatenate(left), np.concatenate(right)
    keep = a != b
    both = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
    yield from rows(2, both[:, 0], both[:, 1], np.zeros(len(both)))


def _groups(batches, keys):
    """Tables of equal ``keys`` from batches sorted by them."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*cols, strict=True))
        begin = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[begin]:
                if at is not None and marks[begin] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = marks[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield at, pa.Table.from_batches(held)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections between the sets numbered ``left`` and those numbered ``right``.

    Shingles that one set alone has are left out; the rest is a 0/1 matrix product, a slice of shingles at a time.
    """
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    term = np.cumsum(new) - 1
    often = np.bincount(term) > 1
    number = np.cumsum(often) - 1
    keep = often[term]
    term, owner = number[term[keep]], owner[keep]
    width = int(often.sum())
    out = np.zeros((len(left), len(right)), np.float64)
    step = max(256, (1 << 24) // max(len(sets), 1))
    cut = np.searchsorted(term, np.arange(0, width + step, step))
    for i in range(len(cut) - 1):
        a, b = cut[i], cut[i + 1]
        if a == b:
            continue
        m = np.zeros((len(sets), min(step, width - i * step)), np.float32)
        m[owner[a:b], term[a:b] - i * step] = 1
        out += m[left] @ m[right].T
    return out


def _link_cells(n: int, num: int, den: int):
    """Links inside each cell, as few as connect what is linked: a, b.  A cell is one block or two; of two, only pairs across and with
    one member outside the family's main component are compared."""
    def run(batches):
        for (_, bi, bj), table in _groups(batches, ("family", "bi", "bj")):
            rep = table.column("rep").to_numpy()
            sets = list(shingle_sets(table.column("text"), n))
            size = np.array([len(s) for s in sets])
            blk, out, comp = (table.column(c).to_numpy(zero_copy_only=False) for c in ("block", "outside", "comp"))
            if bi == bj:
                left = right = np.arange(len(rep))
            else:
                left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            if not len(left) or not len(right):
                continue
            common = overlaps(sets, left, right)
            union = size[left][:, None] + size[right][None, :] - common
            linked = den * common >= num * union
            if bi != bj:
                linked &= (out[left][:, None] | out[right][None, :]) & (comp[left][:, None] != comp[right][None, :])
            x, y = np.nonzero(linked)
            x, y = left[x], right[y]
            root = list(range(len(rep)))

            def find(v, root=root):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v
            a, b = [], []
            for v, w in zip(x.tolist(), y.tolist(), strict=True):
                if v != w:
                    p, q = find(v), find(w)
                    if p != q:
                        root[p] = q
                        a.append(rep[v])
                        b.append(rep[w])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _plausible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b that their sketches do not rule out, and those alike enough to be looked at together."""
    left = sketches.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                apart = _bits_apart(_Binary(batch.column("sa")), _Binary(batch.column("sb")))
                # a pair at Jaccard 1/2 differs in a third of both sizes; hashing hides some of that
                keep = (apart <= (na + nb) * (den - num) // (den + num)) | (apart <= (na + nb) // 4)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def _cells_of(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each ``key`` in blocks of about BLOCK, each row in the cells (bi <= bj) of its block with every block."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))


def _between_families(placed: DataFrame, sketches: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """Pairs a, b that join families: members of one list, from different families, whose sketches do not rule out a link.

    All such pairs of a list are looked at, block by block; a cell names as few as join what can be joined.
    """
    known = sketches.select(F.col("sig").alias("node"), "n", "sketch")
    cells = _cells_of(placed.join(known, "node"), "list").select("list", "bi", "bj", "block", "node", "root", "flags", "n", "sketch")

    def run(batches):
        for (_, bi, bj), table in _groups(batches, ("list", "bi", "bj")):
            node, root, flags, n, block = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "root", "flags", "n", "block"))
            raw = table.column("sketch").to_pylist()
            width = min(map(len, raw))
            bits = np.concatenate([_fold(np.frombuffer(x, np.uint8)[None, :], width) for x in raw])
            left, right = (np.arange(len(node)),) * 2 if bi == bj else (np.flatnonzero(block == bi), np.flatnonzero(block == bj))
            joined = {r: r for r in root.tolist()}

            def find(v, joined=joined):
                while joined[v] != v:
                    joined[v] = joined[joined[v]]
                    v = joined[v]
                return v
            a, b = [], []
            for x in left.tolist():
                apart = np.bitwise_count(bits[right] ^ bits[x]).sum(1)
                meets = ((flags[x] & PROBE > 0) & (flags[right] & INDEX > 0)) | ((flags[x] & INDEX > 0) & (flags[right] & PROBE > 0))
                for y in right[meets & (root[right] != root[x]) & (apart <= (n[right] + n[x]) * (den - num) // (den + num))].tolist():
                    p, q = find(int(root[x])), find(int(root[y]))
                    if p != q:
                        joined[p] = q
                        a.append(node[x])
                        b.append(node[y])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.repartition(tasks, "list", "bi", "bj").sortWithinPartitions("list", "bi", "bj").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Linked groups of texts: key, ``n_shingles``, ``component_id`` (smallest key reachable by links, the row's own included).

    Two rows link when den * |intersection| >= num * |union| of their sets of n-word shingles (ASCII letters lower-cased; words are cut
    at white space).  The result is exact: every link counts, however large a group is.

    1. One pass over the texts emits per set its segment entries in blobs per bucket, and a small sketch; equal sets are emitted
       once per task.  One shuffle brings the entries of a segment together.
    2. Short lists name their pairs, long lists a star.  Sketches rule out what cannot link (they never rule out a link) and pairs
       that are alike form families.  Long lists that still hold several families are searched, in blocks, for pairs between them.
    3. Families hold every link.  They are compared in blocks of at most BLOCK sets: each block with itself, then blocks with each
       other for the sets not yet in the family's main component.  A cell returns a spanning forest, so rows stay linear.

    Only components are given: neither the linked pairs nor the links of a row, since pairs within a component that is already
    known are not verified.

    Texts that have no words, or are null, have an empty set and link with nothing, not with each other.  Rows with equal sets
    link.  A null key takes part and never names a component unless all keys there are null.  Repeated keys are rows of their
    own.  Other columns are ignored.  An empty table gives no rows.  Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    slim = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    passed = slim.mapInArrow(_emit(n, num, den, 4 * tasks), PASS).repartition(tasks, "bucket").mapInArrow(_match, PASS)
    found = land(passed, "join-pass")
    rows = found.where("kind = 0").select(F.col("a").alias("_key"), F.col("b").alias("sig"), "n", F.col("blob").alias("sketch"))
    reps = land(rows.where("n > 0").groupBy("sig").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "join-sets")

    pairs = found.where("kind = 2").select("a", "b").distinct()
    alike = land(_plausible(pairs, reps, num, den), "join-alike")
    family = land(components(alike), "join-family")

    members = found.where("kind = 3").select(F.col("a").alias("list"), F.col("b").alias("node"), F.col("n").alias("flags"))
    placed = members.join(family, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("list").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("list")
    placed = land(placed.join(mixed, "list", "left_semi"), "join-mixed")
    if not placed.isEmpty():
        more = land(_between_families(placed, reps, tasks, num, den), "join-alike")
        if not more.isEmpty():
            family = land(components(alike.unionByName(more)), "join-family")

    # families in blocks; a family's size is known from one row per family
    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    dealt = family.join(sizes, "root").join(reps.select(F.col("sig").alias("node"), "least"), "node")
    dealt = land(dealt.select(F.col("root").alias("family"), F.col("node").alias("rep"), "least", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
                 .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "join-dealt")
    wanted = dealt.select("rep", "least")
    if dealt.count() <= broadcast_rows:  # 16 bytes a row
        wanted = F.broadcast(wanted)
    # a repeated key may stand for several texts: the set decides
    texts = slim.join(wanted, F.col("_key").eqNullSafe(F.col("least"))).select("rep", "_key", F.col("_text").alias("text"))
    texts = land(_own_text(texts, n), "join-texts")
    dealt = dealt.join(texts, "rep")

    cells = dealt.select("family", "rep", "block", "text", F.col("block").alias("bi"), F.col("block").alias("bj"), F.lit(False).alias("outside"), F.lit(0).cast("long").alias("comp"))
    links = land(_run_cells(cells, tasks, n, num, den), "join-links")
    wide = dealt.where("blocks > 1")
    if not wide.isEmpty():
        comp = components(links)
        owned = wide.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
        count = owned.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
        main = count.groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        owned = land(owned.join(main, "family").withColumn("outside", F.col("comp") != F.col("main")), "join-outside")
        # a pair of blocks is visited when one of them has a set outside the main component
        odd = owned.where("outside").select("family", F.col("block").alias("o")).distinct()
        partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        visits = owned.select("family", "blocks").distinct().join(odd, "family").select("family", "o", partner.alias("p")).where("o <> p")
        visits = visits.select("family", F.least("o", "p").alias("bi"), F.greatest("o", "p").alias("bj")).distinct()
        ends = visits.select("*", F.explode(F.array("bi", "bj")).alias("block"))
        cells = owned.join(ends, ["family", "block"]).select("family", "rep", "block", "text", "bi", "bj", "outside", "comp")
        links = links.unionByName(land(_run_cells(cells, tasks, n, num, den), "join-links"))

    linked = components(links)
    named = linked.join(reps.select(F.col("sig").alias("node"), "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = linked.join(least, "root").select(F.col("node").alias("sig"), "component_id")
    copies = reps.where("copies > 1").select("sig", F.col("least").alias("own"))
    of_set = copies.join(of_set, "sig", "full").select("sig", F.coalesce("component_id", "own").alias("component_id"))
    out = rows.drop("sketch").join(of_set, "sig", "left")
    single = F.col("_key")
    return out.select(F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", single)).otherwise(single).alias("component_id"))


def _own_text(texts: DataFrame, n: int) -> DataFrame:
    """Rows whose text has the set ``rep``, one per set."""
    def check(batches):
        for batch in batches:
            if batch.num_rows:
                sig = signatures(list(shingle_sets(batch.column("text"), n)))
                keep = pa.array(_signed(sig) == batch.column("rep").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("rep").filter(keep), batch.column("text").filter(keep)], names=["rep", "text"])

    right = texts.select("rep", "text").mapInArrow(check, "rep long, text string")
    # only keys that repeat give a set twice
    return right.groupBy("rep").agg(F.min("text").alias("text"))


def _run_cells(cells: DataFrame, tasks: int, n: int, num: int, den: int) -> DataFrame:
    cut = cells.repartition(tasks, "family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
    return cut.mapInArrow(_link_cells(n, num, den), "a long, b long")
