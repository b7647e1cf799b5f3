import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding


def plain_shards(rows, shards):
    out, before = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    total, slots = sum(len((t or "").encode()) + 8 for _, t in rows), Counter()
    for k, t in ordered:
        size = len((t or "").encode()) + 8
        s = min(shards - 1, shards * (2 * before + size) // (2 * total))
        out.append((k, size, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
        before += size
    return sorted(out, key=repr)


def test_shards_equal_one_running_sum(spark):
    rows = [(i * 7 % 501, "ü" * (i * i % 97) if i % 11 else None) for i in range(501)] + [(None, "x"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((tuple(r) for r in sharding.byte_shards(df, 24).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr)
    assert got == plain_shards(rows, 24)
    size = Counter()
    for _, s, _, shard, _ in got:
        size[shard] += s
    assert max(size.values()) - min(size.values()) <= 2 * max(r[1] for r in got)


def test_shards_of_odd_rows(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    got = sharding.byte_shards(edge_docs, 4).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_shards(rows, 4)
    assert sharding.byte_shards(no_docs, 4).count() == 0


def water(sizes, cycle=(1, 2, 3), most=3):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 20, None: 7}, {"x": 5}, {"a": 0, "b": 3}, {f"s{i}": i * i + 1 for i in range(30)}, {"a": 1, "b": 1, "c": 1000, "d": 2}])
def test_targets_equal_repeated_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def texts(n, seed=3):
    return [(i, " ".join(["w"] * (1 + (i * 7919 + seed) % 83 + (900 if i % 101 == 0 else 0))), f"s{i % 5}" if i % 3 else "hot") for i in range(n)]


def test_mix_meets_its_targets(spark):
    rows = texts(3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_to_targets(df, block=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    size, taken = Counter(), Counter()
    for r, (i, t, s) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        assert r["size"] == len(t.split()) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source"] == s
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= int(rate) + 1
        size[s] += r["size"]
        taken[s] += r["taken"]
    want = water(size)
    assert all(abs(taken[s] - want[s]) < 45 for s in want)  # less than half of a usual text
    again = mixing.mix_to_targets(df.repartition(3), block=16)  # another layout, the same draws
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_rounding_is_fair(spark):
    """Each unit becomes 1 as often as its probability says, over many strata."""
    units = spark.range(4000).select((F.col("id") / 8).cast("long").alias("stratum"), F.col("id").alias("uid"), F.xxhash64("id").alias("print"), F.lit(0.3).alias("p"), (1 + 3 * (F.col("id") % 8)).alias("size"))
    won = {r["uid"] for r in mixing.pivotal_rounding(units, block=4).collect()}
    share = defaultdict(float)
    for u in won:
        share[u % 8] += 1 / 500
    assert all(abs(share[k] - 0.3) < 0.08 for k in range(1, 8))  # the smallest takes what rounding leaves
    words = Counter()
    for u in won:
        words[u // 8] += 1 + 3 * (u % 8)
    assert sum(abs(words[s] - 0.3 * sum(1 + 3 * k for k in range(8))) for s in range(500)) / 500 < 8


def test_mix_of_odd_rows(spark, edge_docs, no_docs):
    got = mixing.mix_to_targets(edge_docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted([(False, 1, 8), (False, 1, 8), (False, 2, 0), (False, 3, 0), (False, 4, 0), (True, 0, 8), (False, 5, 120_000), (False, 6, 4), (False, 7, 1)])
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_to_targets(no_docs).count() == 0
    back = mixing.repeated_to_targets(edge_docs)
    assert back.columns == edge_docs.columns
    per = Counter(r["doc_id"] for r in back.collect())
    assert all(per[k] == 1 for k in (2, 3, 4))
    assert mixing.repeated_to_targets(no_docs).count() == 0
