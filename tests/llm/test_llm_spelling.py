import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm import spelling as sp


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, times=2):
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in known.items():
        near = [v for v in known if one_edit(w, v)]
        best = min(near, key=lambda v: (-known[v], v), default=None)
        form = best if best and known[best] >= times * n else None
        out[w] = [form, None, n, len(near), known[form] if form else None]
    for w, row in out.items():
        end = w
        while out[end][0]:
            end = out[end][0]
        row[1] = end
    return {w: tuple(r) for w, r in out.items()}


def words_of(r, n=250, alphabet="abcdeéñ"):
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(4, 9))) for _ in range(n)]
    for w in list(base):
        i = r.randrange(len(w))
        base.append(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1:]]))
    return base


def occurrences(spark, counts):
    rows = [(w, n, "form", 1, 2) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n int, form string, cell int, role int")
    return df.selectExpr("word", "n", "form", "cell", "role", "explode(sequence(1, n)) AS i")


def as_rows(df):
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in df.collect()}


@pytest.mark.parametrize("data, query", [(sp.DATA_LETTERS, sp.QUERY_LETTERS), (60, 90)])
def test_equals_all_pairs(spark, monkeypatch, data, query):
    monkeypatch.setattr(sp, "DATA_LETTERS", data)
    monkeypatch.setattr(sp, "QUERY_LETTERS", query)
    r = random.Random(5)
    counts = Counter({w: r.choice([1, 2, 3, 3, 4, 6, 12, 24, 48]) for w in words_of(r)})
    counts.update({"hausen": 48, "hausem": 12, "hausexm": 3})
    counts["abc" * 30_000] = 4  # very long words, one edit apart
    counts["abc" * 30_000 + "d"] = 9
    got = as_rows(sp.spelling_variants(occurrences(spark, counts).repartition(4)))
    want = plain(counts)
    assert got == want and sum(v[0] is not None for v in want.values()) > 40 and len({v[1] for v in want.values() if v[0]}) > 10
    chains = [w for w, v in want.items() if v[0] and v[0] != v[1]]
    assert chains  # some forms have forms of their own


def test_trie_finds_what_one_edit_reaches():
    r = random.Random(1)
    words = sorted({w for w in words_of(r, 400, "abc") if len(w) == 6})
    askers = sorted({w for w in words_of(r, 400, "abc") if len(w) in (5, 6, 7)})
    trie = sp.CountTrie(words, r.sample(range(sp.GROUPS), sp.GROUPS))
    for length in (5, 6, 7):
        some = [w for w in askers if len(w) == length]
        left, right = trie.near(some)
        got = sorted((some[i], trie.words[j]) for i, j in zip(left, right, strict=True))
        assert got == sorted((a, b) for a in some for b in words if one_edit(a, b))


def test_every_edit_reaches_its_cell():
    r = random.Random(2)
    words = ["".join(r.choice("aabcdé") for _ in range(r.choice([1, 2, 5, 9, 300, 600]))) for _ in range(60)]
    order = list(range(sp.GROUPS))
    for w in words:
        i = r.randrange(len(w))
        for v in (w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1:]):
            if v:
                cell = dict((role, cells) for role, cells, _ in sp._routes(order, [v]))[0][0]
                asked = dict((role, cells) for role, cells, _ in sp._routes(order, [w]))[1]
                assert cell in asked and len(asked) == len(np.unique(asked)) <= 31


def documents_of(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, run int, h int")


def counted(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def test_registered_query_and_its_sql(spark, tmp_path):
    r = random.Random(7)
    lexicon = [w.capitalize() if r.random() < 0.3 else w for w in words_of(r, 60, "abcdeÉñ")]
    docs = [(i, " ".join(r.choices(lexicon, k=120)) + r.choice([" KKelvin İstanbul.", "", "-x-"])) for i in range(150)] + [(1, None), (2, ""), (5, " 一 ")]
    documents_of(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_spelling_trie"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(counted(docs))
    assert as_rows(got) == want and len(want) > 100
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = db.execute(queries.SQL["op12_spelling_trie"]).fetchall()
    assert {x[0]: tuple(x[1:]) for x in rows} == want


def test_odd_rows(spark):
    docs = [(None, "Haus Hausen hausen HAUSEN hausem"), (None, "hausem"), (3, "hausem"), (4, None), (5, ""), (6, "x" * 100_000), (6, "x" * 100_000), (7, "x" * 100_000), (8, "x" * 99_999 + "Y" + " Àrger àrger " * 3)]
    df = documents_of(spark, docs)
    assert as_rows(sp.spelling_variants(sp.letter_runs(df, every=10**9))) == plain({**Counter({"hausen": 3, "hausem": 3, "x" * 100_000: 3, "Àrger": 3, "àrger": 3})})
    assert sp.spelling_variants(sp.letter_runs(df.where("false"))).count() == 0
    nothing = spark.createDataFrame([(None,), ("",), ("abcd",)], "word string")
    assert sp.spelling_variants(nothing, least_count=1).count() == 0
