"""Mixing sources to target weights by dependent rounding of fractional copy counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import land

WORDS = r"[^\x20\x09-\x0D]+"  # fixed by the contract: what counts as a word


def word_count(text: str = "text"):
    """Words of a text: it starts one wherever a word character follows a separator or the beginning."""
    body = F.coalesce(F.col(text), F.lit(""))
    one_space = F.translate(body, "\t\n\u000b\f\r", "     ")
    # the number of words is the number of non-empty pieces
    return F.size(F.array_remove(F.split(one_space, " "), "")).cast("long")


def source_targets(sizes: DataFrame, cycle=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """Target words per source from (source, source_size): shares by the cycle of weights over sources in code point
    order, null last, of 100 % of all words; no target exceeds ``most`` times its source, what is cut off is shared
    among the others by weight until none exceeds it.

    With sources ordered by limit over weight, the capped ones are a prefix; the level of the rest is what the prefix
    leaves divided by the remaining weight.  One row per source is all that meets in the window.
    """
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int")))
    limit = F.lit(float(most)) * F.col("source_size")
    weighted = weighted.withColumn("limit", limit).withColumn("knee", F.col("limit") / F.col("weight"))
    before = Window.orderBy("knee", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("knee", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("knee", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = weighted.withColumn("level", level).withColumn("free", F.col("level") <= F.col("knee"))
    # the level that holds is that of the first source not capped
    held = F.min(F.when(F.col("free"), F.struct("knee", "place", "level"))).over(whole)["level"]
    return levelled.select("source", "source_size", F.coalesce(F.least("limit", F.col("weight") * held), F.col("limit")).alias("target"))


RESERVE = 4  # blocks of each size class that wait for what larger classes leave


def _fold(block: str, round_no: int, seed: int):
    """Fold a block's units, in their order, by the pivotal rule with words as mass.

    The holder (mass a words a copy, probability p) meets the next unit (b, q).  Words move from one to the other until one
    of the two is integral: up to min(a (1 - p), b q) to the holder or up to min(a p, b (1 - q)) from it.  Which way is
    drawn so that both keep their expectation; a p + b q never changes.  The fold returns the units that became 1 and
    the one left with a fraction.
    """
    eps = 1e-9
    unit = "named_struct('uid', {0}.uid, 'print', {0}.print, 'p', {1}, 'size', {0}.size)"
    draw = f"(pmod(xxhash64({seed}, {round_no}, a.held.print, x.print), {1 << 52}) / {float(1 << 52)}D)"
    fill, give = "(a.held.size * (1D - a.held.p))", "(x.size * x.p)"    # what the holder lacks, what the next can give
    drop, take = "(a.held.size * a.held.p)", "(x.size * (1D - x.p))"    # what the holder can give, what the next lacks
    up = f"({draw} * (least({fill}, {give}) + least({drop}, {take})) < least({drop}, {take}))"
    keep = lambda who, p, won: f"named_struct('held', {unit.format(who, p)}, 'won', {won})"
    add = lambda who: f"concat(a.won, array({who}.uid))"
    merge = f"""CASE
        WHEN x.p <= {eps} THEN a
        WHEN x.p >= {1 - eps} THEN named_struct('held', a.held, 'won', {add('x')})
        WHEN a.held.p <= {eps} THEN {keep('x', 'x.p', 'a.won')}
        WHEN a.held.p >= {1 - eps} THEN {keep('x', 'x.p', add('a.held'))}
        WHEN {up} AND {fill} <= {give} THEN {keep('x', f'x.p - {fill} / x.size', add('a.held'))}
        WHEN {up} THEN {keep('a.held', f'a.held.p + {give} / a.held.size', 'a.won')}
        WHEN {drop} <= {take} THEN {keep('x', f'x.p + {drop} / x.size', 'a.won')}
        ELSE {keep('a.held', f'a.held.p - {take} / a.held.size', add('x'))} END"""
    start = "named_struct('held', named_struct('uid', CAST(NULL AS BIGINT), 'print', CAST(NULL AS BIGINT), 'p', 0D, 'size', CAST(1 AS BIGINT)), 'won', CAST(array() AS ARRAY<BIGINT>))"
    return F.expr(f"aggregate({block}, {start}, (a, x) -> {merge})")


def _last_fold(units: str, seed: int):
    """Fold a stratum's last units, largest first: each meets all units behind it as one partner, by the same rule.

    Words move between the unit and the rest, whose probabilities shrink towards 0 or grow towards 1 by a common factor, so
    the rest's current probabilities are u * p + v.  Against a partner that large every unit becomes integral at once;
    only when nothing is left behind it may a small unit keep a fraction, which goes to the nearer side.
    """
    eps = 1e-9
    let = lambda values, then: F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), then), 1)

    def step(a, x):
        def moved(c):
            up = c["draw"] * (c["alpha"] + c["beta"]) < c["beta"]
            shrink = F.when(c["mass"] > 0, 1.0 - c["alpha"] / c["mass"]).otherwise(1.0)
            grow = F.when(c["size"] - c["mass"] > eps, c["beta"] / (c["size"] - c["mass"])).otherwise(0.0)
            end = F.when(up, c["p"] + c["alpha"] / x["size"]).otherwise(c["p"] - c["beta"] / x["size"])
            return F.struct(F.when(up, a["u"] * shrink).otherwise(a["u"] * (1.0 - grow)).alias("u"), F.when(up, a["v"] * shrink).otherwise(a["v"] * (1.0 - grow) + grow).alias("v"), c["size"].alias("size"),
                            F.greatest(F.when(up, c["mass"] - c["alpha"]).otherwise(c["mass"] + c["beta"]), F.lit(0.0)).alias("mass"),
                            F.when(end >= 0.5, F.concat(a["won"], F.array(x["uid"]))).otherwise(a["won"]).alias("won"))

        def bounds(b):
            first = {"p": b["p"], "size": b["size"], "mass": b["mass"], "draw": F.pmod(F.xxhash64(F.lit(seed), x["print"]), F.lit(1 << 52)) / F.lit(float(1 << 52)),
                     "alpha": F.least(x["size"] * (1.0 - b["p"]), b["mass"]), "beta": F.least(x["size"] * b["p"], F.greatest(b["size"] - b["mass"], F.lit(0.0)))}
            return let(first, moved)

        def rest(q):
            return let({"p": q["p"], "size": a["size"] - x["size"], "mass": F.greatest(a["mass"] - x["size"] * q["p"], F.lit(0.0))}, bounds)
        return let({"p": F.least(F.greatest(a["u"] * x["p"] + a["v"], F.lit(0.0)), F.lit(1.0))}, rest)

    total = lambda f: F.aggregate(units, F.lit(0.0), lambda acc, x: acc + f(x))
    start = F.struct(F.lit(1.0).alias("u"), F.lit(0.0).alias("v"), total(lambda x: x["size"].cast("double")).alias("size"), total(lambda x: x["size"] * x["p"]).alias("mass"),
                     F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("won"))
    return F.aggregate(units, start, step, lambda a: a["won"])


def pivotal_rounding(units: DataFrame, block: int = 64, seed: int = 11) -> DataFrame:
    """Round probabilities to 0 or 1 with each stratum's sum of p * size kept: which units (``uid``, unique) become 1.

    ``units``: stratum long, uid long, print long (what the draws hang on), p double in [0, 1), size long >= 1.

    A reduction tree: units of a stratum and size class (powers of 4) are dealt into blocks of about ``block``; a block is
    folded by the pivotal rule and leaves at most one fraction; fractions meet in blocks again until a class has at most
    ``block``.  A round shuffles a ``block``-th of the rows before it, so the tree has log_block(n) levels.  RESERVE blocks per class
    are set aside for the last fold of a stratum, where each unit, largest first, meets all smaller ones together: they take up
    what it leaves, so the words of a stratum are off by less than one small unit.  No task ever holds more than a block,
    or RESERVE + 1 blocks per size class.
    """
    won, pool = [], []
    level = units.withColumn("kind", F.floor(F.log2("size") / 2).cast("int"))
    depth = 0
    fields = ["stratum", "uid", "print", "p", "size", "kind"]
    members = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "print", "uid", "p", "size")))
    while True:
        counts = level.groupBy("stratum", "kind").agg(F.count(F.lit(1)).alias("n"))
        cuts = counts.select("stratum", "kind", F.ceil(F.col("n") / block).alias("blocks"))
        dealt = level.join(cuts, ["stratum", "kind"]).withColumn("deal", F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "print"), F.col("blocks")))
        aside = (F.col("deal") < RESERVE) if depth == 0 else (F.col("blocks") <= 1)
        dealt = land(dealt.select(*fields, "deal", aside.alias("aside")), "mix-dealt")
        pool.append(dealt.where("aside").select("stratum", "uid", "print", "p", "size"))
        folded = dealt.where("NOT aside").groupBy("stratum", "kind", "deal").agg(members.alias("units"))
        folded = land(folded.select("stratum", "kind", _fold("units", depth, seed).alias("end")), "mix-round")
        won.append(folded.select(F.explode("end.won").alias("uid")))
        rest = folded.select("stratum", "kind", "end.held.*")
        won.append(rest.where(F.col("p") >= 1 - 1e-9).select("uid"))
        level = rest.where(F.col("p").between(1e-9, 1 - 1e-9)).select(*fields)
        depth += 1
        if level.isEmpty():
            break
    gathered = pool[0]
    for part in pool[1:]:
        gathered = gathered.unionByName(part)
    last = gathered.groupBy("stratum").agg(members.alias("units")).select(_last_fold("units", seed + depth).alias("won"))
    won.append(land(last, "mix-last").select(F.explode("won").alias("uid")))
    out = won[0]
    for part in won[1:]:
        out = out.unionByName(part)
    return out


def _copies(slim: DataFrame, cycle, most: float, block: int, seed: int) -> DataFrame:
    """``slim``: source, size, print and any other columns; adds source_size, target, copies and taken."""
    # order and draws hang on the content alone, so another layout of the files changes nothing; the number only names rows
    slim = land(slim.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    sizes = land(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = source_targets(sizes, cycle, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = land(targets.withColumn("stratum", F.xxhash64("source")).withColumnRenamed("source", "of"), "mix-targets")
    rated = slim.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    units = rated.where("size > 0").select("stratum", "uid", "print", (F.col("rate") - F.floor("rate")).alias("p"), "size")
    winners = pivotal_rounding(units.where(F.col("p").between(1e-9, 1 - 1e-9)), block, seed).withColumn("extra", F.lit(1))
    whole = F.floor("rate") + F.when(F.col("rate") - F.floor("rate") > 1 - 1e-9, 1).otherwise(0)  # a rate that is integral but for rounding
    copies = F.when(F.col("size") > 0, whole + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long")
    out = rated.join(winners, "uid", "left").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("uid", "extra", "rate", "stratum")


def mix_to_targets(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle=(1, 2, 3), most: float = 3.0, block: int = 64,
                   seed: int = 11) -> DataFrame:
    """Copies per row so that each source's words meet its target: columns key, source, ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken`` = copies * size.

    Every row of a source has the same expected number of copies, target over source size (at most ``most``); its whole
    part is given, its fraction is rounded together with the other rows' by the pivotal method, so a source's words miss
    their target by less than one (usually small) text.  Nothing depends on how the rows are laid out in files.

    A null text has size 0, and rows without words take no part (0 copies, 0 taken).  A null source is a source of its
    own, ordered last.  Repeated rows and repeated keys are rounded row by row.  An empty table gives no rows.  Other
    columns are ignored.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(key), F.col(source), F.col(text)).alias("print"))
    out = _copies(slim, cycle, most, block, seed)
    return out.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", "taken")


def repeated_to_targets(docs: DataFrame, text: str = "text", source: str = "source", cycle=(1, 2, 3), most: float = 3.0, block: int = 64, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them: not at all, or up to ceil(``most``) times.

    Rows without words weigh nothing in any target and stay once.  Rows equal in every column share their copies: the sum
    of what each was given comes back.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*docs.columns).alias("print"))
    slim = docs.select(F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(*docs.columns).alias("print"))
    given = _copies(slim, cycle, most, block, seed).groupBy("print").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("times"), F.count(F.lit(1)).alias("equal"))
    joined = rows.join(given.where("times > 0"), "print")
    once = joined.where("equal = 1").select("row", "times")
    several = joined.where("equal > 1").groupBy("print").agg(F.first("row").alias("row"), F.first("times").alias("times")).select("row", "times")
    return once.unionByName(several).select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
