import random
from collections import defaultdict

import numpy as np
import pytest

import tidemark.llm.components as comp
from tidemark.llm import ngram_join as nj
from tidemark.llm.components import components

FILLER = [f"w{i}" for i in range(4000)]


def brute(rows, n, num, den):
    """Components by comparing all pairs of word shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return sorted((k, len(sets[i]), min(least[find(i)])) for i, (k, _) in enumerate(rows))


def corpus(seed, families=12, members=9, lengths=(3, 400)):
    r, rows = random.Random(seed), []
    passage = [r.choice(FILLER) for _ in range(40)]
    for _ in range(families):
        base = [r.choice(FILLER) for _ in range(r.randint(*lengths))]
        for _ in range(r.randint(1, members)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                at = r.randrange(len(w))
                w[at:at + r.randint(0, 2)] = [r.choice(FILLER) for _ in range(r.randint(0, 2))]
                w = w or ["x"]
            if r.random() < 0.3:
                w += passage
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2), (2, 50, 100, 3)])
def test_equals_all_pairs(spark, n, num, den, seed):
    rows = corpus(seed) + [(9000 + i, t) for i, t in enumerate(["", None, "one", "ONE", "one two", "one two", "a b c"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nj.jaccard_components(df, n=n, num=num, den=den).collect())
    assert got == brute(rows, n, num, den)


def test_one_large_family_in_many_blocks(spark, monkeypatch):
    """Copies of one text, many of them close to the threshold, in blocks of seven and lists longer than the pair limit."""
    monkeypatch.setattr(nj, "BLOCK", 7)
    r = random.Random(5)
    base = [r.choice(FILLER) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in nj.jaccard_components(df).collect())
    assert got == brute(rows, 4, 85, 100)


def test_pigeonhole_never_misses_a_pair():
    """Any two linked sets share a segment entry of which one probes and one is indexed, whatever the counter says."""
    r = np.random.default_rng(0)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        bands = nj.Bands(num, den)
        for trial in range(120):
            size = int(r.integers(2, 300))
            a = r.integers(1, 1 << 63, size, dtype=np.uint64)
            most = (2 * size) * (den - num) // (den + num)
            gone, new = int(r.integers(0, most + 1)), int(r.integers(0, most + 1))
            b = np.concatenate([a[gone:], r.integers(1, 1 << 63, new, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            if den * common < num * (len(a) + len(b) - common) or (len(a) == len(b) == common):
                continue
            entries = []
            for s in (a, b):
                one, counter = {}, r.integers(0, 9, 1 << nj.WATCH).astype(np.uint32)
                n = np.array([len(s)])
                band = bands.of(n)
                for step in (0, 1):
                    k = band + step
                    need = bands.gap(n, np.minimum(bands.low[k + 1] - 1, n * den // num) if step == 0 else n * den // num) + 1
                    if (step == 0 and bands.segments[k][0] <= 1) or (step == 1 and ((n * den // num)[0] < bands.low[k][0] or need[0] <= 1)):
                        continue
                    keys, _ = nj._entries(s, np.zeros(len(s), np.int64), n, (k, bands.segments[k]), need, step == 0, counter)
                    for x in keys.tolist():
                        one[x >> 2] = one.get(x >> 2, 0) | x & 3
                entries.append(one)
            x, y = entries
            assert any(f & 1 and y.get(k, 0) & 2 or f & 2 and y.get(k, 0) & 1 for k, f in x.items()), (num, trial, len(a), len(b))


def test_sketches_never_rule_out():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 63, int(r.integers(1, 900)), dtype=np.uint64)
        b = np.concatenate([a[int(r.integers(0, len(a))):], r.integers(0, 1 << 63, int(r.integers(1, 900)), dtype=np.uint64)])
        x, y = (np.frombuffer(nj.odd_sketch(np.unique(s)), np.uint8)[None, :] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(nj._fold(x, w) ^ nj._fold(y, w)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [1 << 18, 7])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr(comp, "SLICE", size)
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (7, 7), (11, 10), *((100 + i, 101 + i) for i in range(60))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10, **{100 + i: 100 for i in range(61)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_the_input(spark, edge_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(edge_docs).collect()), key=repr)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (None, 5, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 5), (6, 1, 6), (7, 1, 7)], key=repr)
    assert nj.jaccard_components(no_docs).count() == 0
