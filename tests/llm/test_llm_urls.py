import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import linkgraph as lg
from tidemark.llm import queries

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, n int, best int, _k int"
RULES = queries.URL_RULES


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "r", 1, 2, 3) for r in rows], SCHEMA)


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (lowered(m[1]), m[2]) if m else ("", "")


def fitting(host, path, rules):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:1:-1] if fits else (None, None)


def plain(rows, rules, rounds=lg.ROUNDS):
    """The same walks in plain loops with exact sums of floats."""
    seen = [(i, *parts(u), h) for i, u, h in rows]
    judged = {(h, p): fitting(h, p, rules) for _, h, p, _ in seen}
    edges, hosts = Counter(), {h for _, h, _, _ in seen}
    for _, host, _, html in seen:
        for dst in {lowered(x) for x in re.findall(lg.LINK, html or "")}:
            if host and dst != host:
                edges[host, dst] += 1
                hosts.add(dst)
    tied = set()
    for host in hosts:
        labels = host.split(".")
        if len(labels) > 2 and not re.search(lg.NUMERIC, host):
            up = [host, *(".".join(labels[-j:]) for j in range(min(len(labels) - 1, 8), 1, -1))]
            tied |= set(zip(up, up[1:], strict=False))
    for a, b in tied:
        edges[a, b] += 1
        edges[b, a] += 1
    rank = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        seeds = Counter(h for _, h, p, _ in seen if h and judged[h, p][1] == verdict)
        flow = defaultdict(list)
        for (a, b), w in edges.items():
            flow[a if kind == "trust" else b].append((b if kind == "trust" else a, w))
        total = sum(seeds.values())
        start = {h: n / total for h, n in seeds.items()}
        now = start
        for _ in range(rounds):
            nxt = defaultdict(list)
            for h, m in now.items():
                for b, w in flow[h]:
                    nxt[b].append(lg.DAMPING * m * w / sum(x for _, x in flow[h]))
            for h, m in start.items():
                nxt[h].append((1 - lg.DAMPING) * m)
            now = {h: math.fsum(x) for h, x in nxt.items()}
        whole = math.fsum(now.values()) or 1
        rank[kind] = {h: m / whole for h, m in now.items()}
    share = {}
    for h in hosts:
        t, s = rank["trust"].get(h, 0), rank["distrust"].get(h, 0)
        share[h] = s / (s + t) if s + t else None
    return [(i, h, p, judged[h, p][0], judged[h, p][1] or ("block" if (share[h] or 0) > 0.5 else "allow"), share[h]) for i, h, p, _ in seen]


def graph_pages(n=300, seed=0):
    r = random.Random(seed)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "x") for b in ("one", "two", "three", "four", "five") for c in ("net", "com", "org", "example.org")] + ["solo.net", "10.0.0.1", "a.b.c.d.e.f.g.h.i.j.net"]
    out = []
    for i in range(n):
        host = hosts[0] if r.random() < 0.3 else r.choice(hosts)
        links = "".join(r.choice(['<a href="https://{}/x">', "<A HREF='//{}'>", "<img src=http://{}/y?z>", '<a href="/local/{}">']).format(r.choice(hosts).upper() if r.random() < 0.2 else r.choice(hosts)) for _ in range(r.randrange(5)))
        out.append((i, f"http{r.choice(['', 's'])}://{host}{r.choice(['/fr/', '/de/', '/en/1', '/en/2', '/es/', '', '?q=/de/'])}{i}", f"<p>{links}</p>"))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_walks(spark, seed):
    rows = graph_pages(seed=seed)
    got = lg.judged_urls(pages_of(spark, rows).repartition(4), lg.rule_table(spark, RULES)).collect()
    want = {w[0]: w for w in plain(rows, RULES)}
    assert len(got) == len(rows)
    for g in got:
        w = want[g.page_id]
        assert (g.host, g.path, g.rule) == w[1:4]
        assert (g.distrust is None) == (w[5] is None) and (w[5] is None or abs(g.distrust - w[5]) < 1e-6)
        assert g.verdict == w[4] or abs(w[5] - 0.5) < 1e-6
    free = [g for g in got if g.rule is None]
    assert {g.verdict for g in free} == {"allow", "block"}


def test_registered_query_equals_its_sql(spark, tmp_path):
    rows = graph_pages(seed=2) + [(None, None, None), (7, "no scheme", "x"), (8, "http://", None)]
    pages_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op11_link_graph"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(queries.SQL["op11_link_graph"])
    assert [c[0] for c in want.description] == got.columns
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.fetchall()))


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://fan.net/", '<a href="http://bad.com/">'), (3, "http://good.com/fr/1", '<a href="http://named.net/">'), (4, "http://named.net/", ""), (5, "http://lonely.net/", "")]
    got = {g.page_id: g for g in lg.judged_urls(pages_of(spark, rows), lg.rule_table(spark, RULES)).collect()}
    assert {i: g.verdict for i, g in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert (got[2].distrust, got[4].distrust, got[5].distrust) == (1.0, 0.0, None)


def test_odd_rows_and_rules(spark):
    long = "http://long.com/de/" + "x" * 300_000 + "?" + "y" * 1000
    deep = "http://" + "a." * 5000 + "com/fr/1"
    rows = [(1, None, None), (None, "HTTP://WWW.Example.ORG/es/1?a://b", ""), (None, "HTTP://WWW.Example.ORG/es/1?a://b", ""), (2, "mailto:x", "<a href='//www.example.org'>"), (3, "x\n://É.COM/fr/", ""), (4, long, ""), (5, deep, ""),
            (6, "http://notexample.org/es/", ""), (7, "http://example.org/en/12", ""), (8, "http://org", ""), (9, "", "")]
    got = sorted(((g.page_id or 0, g.host, g.path, g.rule, g.verdict) for g in lg.judged_urls(pages_of(spark, rows), lg.rule_table(spark, RULES)).collect()))
    assert got == sorted((w[0] or 0, *w[1:5]) for w in plain(rows, RULES))
    assert [g for g in got if g[0] == 0][0][3:] == ("example.org/es/", "block")
    assert lg.judged_urls(pages_of(spark, rows).where("false"), lg.rule_table(spark, RULES)).count() == 0
    none = lg.rule_table(spark, RULES).where("false")
    assert {(g.rule, g.verdict) for g in lg.judged_urls(pages_of(spark, rows), none, unknown="block").collect()} == {(None, "block")}
    twice = spark.createDataFrame([("com", "/fr/", "allow"), ("com", "/fr/", "block"), (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert {g.verdict for g in lg.judged_urls(pages_of(spark, rows), twice).collect() if g.rule} == {"block"}
