"""Verdicts on URLs: rules first, then trust and distrust that travel along the links between hosts."""

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, land

UNIT = 10**12       # one whole mass of trust or distrust, in the whole numbers that the ranks are
DAMPING = 0.85
ROUNDS = 20
#: The parts of a URL: host and path.  A link of a page names another host after ``//``.
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
NUMERIC = r"(^|\.)[0-9]+(:[0-9]+)?$"


def lower_ascii(c):
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url):
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    known = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(known, URL, 1)), F.regexp_extract(known, URL, 2)


def rule_table(spark, rules) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def ruled(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct host and start of path: host, pre, n (rows), ``rule`` and its ``verdict`` (both null: none).

    ``parts`` has host and path; ``pre`` is as much of the path as the longest rule looks at.  Rules meet the hosts' last
    labels and the starts of their paths by equality, so neither a host with very many rows nor one with very many rules is gathered.
    Which label counts and path lengths the rules have is all that reaches the driver: at most as many as the longest rule is long.
    """
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    counts = [r[0] for r in rules.select(labels.alias("n")).distinct().orderBy("n").collect()]
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    keys = parts.select("host", F.left("path", F.lit(max(lengths, default=0))).alias("pre")).groupBy("host", "pre").agg(F.count(F.lit(1)).alias("n"))
    keys = land(keys, "url-keys")
    best = rules.withColumn("rule", F.concat("host", "path")).groupBy(F.col("host").alias("at_host"), F.col("path").alias("at_path")).agg(F.max(F.struct(F.length("rule").alias("l"), F.length("host").alias("h"), "verdict", "rule")).alias("best"))
    ends = [F.when(labels >= j, F.substring_index("host", ".", -j)) for j in counts]
    starts = [F.when(F.length("pre") >= n, F.left("pre", F.lit(n))) for n in lengths]
    none = F.array().cast("array<string>")
    probes = keys.select("*", F.explode(F.array_compact(F.array(*ends) if ends else none)).alias("at_host")).select("*", F.explode(F.array_compact(F.array(*starts) if starts else none)).alias("at_path"))
    fits = probes.join(best, ["at_host", "at_path"]).groupBy("host", "pre").agg(F.max("best").alias("best"))
    return land(keys.join(fits, ["host", "pre"], "left").select("host", "pre", "n", "best.rule", "best.verdict"), "url-rules")


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Links between different hosts with the number of pages that hold them: src, dst, w."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), lower_ascii))
    out = pages.select(host_and_path(F.col(url))[0].alias("src"), F.explode(found).alias("dst"))
    return out.where("src <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def domain_links(hosts: DataFrame, least: int, most: int) -> DataFrame:
    """Links, both ways, between each host (column host) and the domains above it that have ``least`` to ``most`` labels: src, dst, w."""
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    named = hosts.where((labels > least) & ~F.rlike("host", F.lit(NUMERIC)))
    steps = [F.when(labels > j, F.struct(F.substring_index("host", ".", -j - 1).alias("a") if j < most else F.col("host").alias("a"), F.substring_index("host", ".", -j).alias("b"))) for j in range(least, most + 1)]
    pairs = named.select(F.inline(F.array_compact(F.array(*steps)))).distinct()
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("w")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1).alias("w")))


def flows(links: DataFrame) -> DataFrame:
    """What a mass at ``src`` gives to ``dst`` in a round: kind, src, dst, share.  Trust follows the links, distrust goes against them."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = both.groupBy("kind", "src", "dst").agg(F.sum("w").alias("w"))
    total = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.lit(DAMPING) * (F.col("w").cast("double") / F.col("total").cast("double"))).alias("share"))


def propagated(flow: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, per_job: int = 5) -> DataFrame:
    """Personalised PageRank of all kinds at once: kind, host, mass.

    ``seeds`` (kind, host, mass) is where a walk starts and restarts.  Masses are whole numbers and shares are rounded down, so the
    result does not depend on the order of sums.  What reaches a host without links ends there, which only scales the ranks of
    its kind.  A round is one join on the source and one aggregate combined before its shuffle; a hub's many links are split by
    adaptive execution; every ``per_job`` rounds are written.
    """
    base = seeds.select("kind", "host", F.floor(F.col("mass") * F.lit(1 - DAMPING)).alias("mass"))
    now = seeds.select("kind", "host", "mass")
    for i in range(1, rounds + 1):
        moved = flow.join(now.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        now = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i % per_job == 0 or i == rounds:
            now = land(now, "url-ranks")
    return now


def host_verdicts(pages: DataFrame, seeds: DataFrame, url: str, html: str, most_distrust: float, domains: tuple[int, int]) -> DataFrame:
    """Hosts that trust or distrust reaches: host, ``distrust`` (its share of both, each kind taken as a whole of 1), ``verdict``.

    ``seeds`` has host, allow, block (numbers of rows that rules decided)."""
    links = land(host_links(pages, url, html), "url-links")
    hosts = seeds.select("host").unionByName(links.select(F.inline(F.array(F.struct(F.col("src").alias("host")), F.struct(F.col("dst").alias("host")))))).distinct()
    flow = land(flows(links.unionByName(domain_links(hosts, *domains))), "url-flows")
    named = seeds.where("host <> ''").select("host", F.inline(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("n"))))).where("n > 0")
    whole = dict(named.groupBy("kind").agg(F.sum("n")).collect())  # two rows at most
    total = F.when(F.col("kind") == "trust", F.lit(whole.get("trust", 1))).otherwise(F.lit(whole.get("distrust", 1))).cast("double")
    start = land(named.select("kind", "host", F.floor(F.lit(float(UNIT)) * (F.col("n").cast("double") / total)).alias("mass")), "url-seeds")
    rank = propagated(flow, start) if whole else start
    sums = dict(rank.groupBy("kind").agg(F.sum("mass")).collect())
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).cast("double") / F.lit(float(max(1, sums.get(kind, 0) or 0)))
    both = rank.groupBy("host").agg(part("trust").alias("t"), part("distrust").alias("s")).where("t + s > 0")
    return both.select("host", (F.col("s") / (F.col("s") + F.col("t"))).alias("distrust")).withColumn("verdict", F.when(F.col("distrust") > most_distrust, "block").otherwise("allow"))


def judged_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_distrust: float = 0.5, unknown: str = "allow", domains: tuple[int, int] = (2, 8)) -> DataFrame:
    """A verdict on each page's URL: key, host, path, ``rule`` (null: none fits), ``verdict``, ``distrust`` of the host.

    ``rules`` has host, path and verdict (allow or block); it fits its host and all hosts below it where the path starts with the
    rule's; the longest wins (of equally long ones that with the longer host, of equal ones block).  Where none fits, the host decides.  Personalised PageRank
    starts trust at the hosts of allowed pages and distrust at those of blocked ones, by their numbers.  Trust follows links (of
    ``href`` and ``src`` to other hosts), distrust goes against them: who links to the blocked is distrusted.  A host and the
    domains above it (of ``domains`` labels at least and at most) link each other, but for numeric addresses.  Hosts whose distrust is more than ``most_distrust`` of
    both are blocked, the others allowed; hosts that neither reaches get ``unknown``.

    A null URL, or one without ``://``, has an empty host and path, no rule and the verdict ``unknown``; pages without text have
    no links.  Repeated rows are judged row by row and count as often; null keys are kept; other columns are not read.  An empty
    table gives no rows; without rules every verdict is ``unknown``.  Null hosts, paths or verdicts of rules are left out.
    """
    rules = land(rules.select("host", "path", "verdict").dropna(), "url-rule-list")
    host, path = host_and_path(F.col(url))
    parts = pages.select(host.alias("host"), path.alias("path"))
    known = ruled(parts, rules)
    seeds = known.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("verdict") == "allow", F.col("n"))), F.lit(0)).alias("allow"), F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("n"))), F.lit(0)).alias("block"))
    by_host = host_verdicts(pages, land(seeds, "url-seed-hosts"), url, html, most_distrust, domains).withColumnRenamed("verdict", "by_links")
    level = land(known.join(by_host, "host", "left").select("host", "pre", "rule", F.coalesce("verdict", "by_links", F.lit(unknown)).alias("verdict"), "distrust"), "url-verdicts")
    longest = rules.select(F.max(F.length("path"))).first()[0] or 0
    name = free_name(pages, "_k")
    rows = pages.select(F.col(key).alias(name), host.alias("host"), path.alias("path")).withColumn("pre", F.left("path", F.lit(longest)))
    return rows.join(level, ["host", "pre"], "left").select(F.col(name).alias(key), "host", "path", "rule", "verdict", "distrust")
