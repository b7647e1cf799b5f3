import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pii, queries

# the contract's own patterns
CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(m):
    digits = [int(c) for c in reversed(m) if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


VALID = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15}


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if VALID[k](m[0])] for k, p in CONTRACT.items()}


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    cols = [c.alias(k) for k, c in pii.base_spans(F.coalesce("text", F.lit(""))).items()]
    return [{k: [(x["s"], x["e"]) for x in r[k]] for k in pii.KINDS} for r in df.select("i", *cols).orderBy("i").collect()]


HARD = ["a@b.cd_x@e.fg", "a@b.c.d@e.fg", "@@a@b", "a@b", "x.y+z%_-@sub-1.ex-.co..", "\U0001f600 é a@b.cc 漢 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1 1.2.3", "00000000000000001.2.3.4", "99999999999999999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000000000000", "41111111111111111111111111", "+1 (555) 010-9999", "+1 (555) 010-9999 ) -", "++49 30 123456 +", "+1+2", "", None, " ",
        "a" * 60_000, "a." * 30_000 + "@b.c", "1" * 50_000, "1 " * 30_000, "1." * 30_000, "x@y" + ".z" * 20_000, "+1" + " -" * 30_000, "+" * 20_000, "-@" * 20_000]


def test_base_spans_equal_the_contract(spark):
    assert spans(spark, HARD) == [plain(t) for t in HARD]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab1234.@+-_ ()%é\U0001f600\n", max_size=60), min_size=40, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    assert spans(spark, texts) == [plain(t) for t in texts]


@pytest.fixture(scope="module")
def contacts(spark):
    """A word that only ever stands before an address, one that often does, and one that stands anywhere."""
    rows = [(i, f"please write to mailbox person{i}@example.org soon") for i in range(40)]
    rows += [(100 + i, "the mailing hall and please write soon to all of the river people") for i in range(200)]
    rows += [(400 + i, "ring telefax +49 30 1234567 today please") for i in range(30)] + [(500, "telefax without a number")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark, contacts):
    found = {r["doc_id"]: r for r in pii.personal_data(contacts, keep_text=True).collect()}
    terms = {t["term"]: t["action"] for r in found.values() for t in r["terms"]}
    assert terms["mailbox"] == "remove" and terms["telefax"] in ("remove", "generalise") and "please" not in terms and "soon" not in terms
    assert all(not found[100 + i]["terms"] for i in range(200)) and not found[500]["terms"]
    row = found[3]
    assert [row["text"][t["s"]:t["e"]] for t in row["terms"] if t["term"] == "mailbox"] == ["mailbox"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(pii.personal_data(contacts, keep_text=True)).collect()}
    assert "person" not in clean[3] and "mailbox" not in clean[3] and "[EMAIL]" in clean[3] and "please write to" in clean[3]
    assert clean[100] == "the mailing hall and please write soon to all of the river people"


def wilson(k, n, z=1.96):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def rated_by_hand(docs):
    """Disclosure of each term, from sets of words per text."""
    texts = [({w for w in re.findall(r"[^\W\d_]+", re.sub(CONTRACT["email"], " ", t or "").lower())}, {k for k, v in plain(t).items() if v}) for t in docs]
    rates = {k: sum(k in kinds for _, kinds in texts) / len(texts) for k in pii.KINDS}
    out = {}
    for term in {w for words, _ in texts for w in words}:
        kinds = [kinds for words, kinds in texts if term in words]
        both = [(math.log(wilson(n, len(kinds)) / rates[k]) / -math.log(rates[k]), k) for k in pii.KINDS if (n := sum(k in x for x in kinds)) and rates[k] < 1]
        out[term] = (len(kinds), *(max(both) if both else (None, None)))
    return out


def test_disclosure_equals_counts_of_texts(spark, contacts):
    docs = [r["text"] for r in contacts.collect()] + ["mailbox " * 30 + "x@y.org", "mailbox mailbox", None, ""]  # repeats within a text prove nothing
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    spans = pii.personal_data(df, keep_text=True)
    has = [(F.size(k) > 0).alias(f"has_{k}") for k in pii.KINDS]
    words = spans.select(*has, F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", CONTRACT["email"], " ")), r"[^\p{L}]+"))).alias("term")).where("term <> ''")
    got = {r["term"]: r for r in pii.document_terms(words, spans.select(*has), 1.96).collect()}
    want = rated_by_hand(docs)
    assert set(got) == set(want) and got["mailbox"]["n_all"] == 42
    for term, (n, disclosure, kind) in want.items():
        assert got[term]["n_all"] == n and (got[term]["disclosure"] is None) == (disclosure is None)
        assert disclosure is None or math.isclose(got[term]["disclosure"], disclosure, rel_tol=1e-9, abs_tol=1e-12) and got[term]["kind"] == kind


def test_registered_query(spark, contacts, tmp_path):
    """Digest columns against the contract, terms against the hand-made rating and a plain search."""
    docs = [(r["doc_id"], r["text"]) for r in contacts.collect()] + [(900 + i, t) for i, t in enumerate(HARD[:21])]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, email int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_disclosing_terms"](spark, str(tmp_path)).collect()}
    flagged = {t for t, (_, v, _) in rated_by_hand([t for _, t in docs]).items() if v is not None and v >= 0.75}
    assert len(got) == len(docs) and {"mailbox", "telefax"} <= flagged
    for i, t in docs:
        base = plain(t)
        spans = [f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k]]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        inside = lambda m: any(s < m.end() and m.start() < e for s, e in base["email"])  # noqa: E731,B023
        words = [m for m in re.finditer(r"[^\W\d_]+", t or "") if m[0].lower() in flagged and not inside(m)]
        assert got[i]["spans"] == ",".join(spans + [f"term:{m.start()}:{m.end()}" for m in words])


def test_terms_of_the_whole_table(spark, contacts):
    """A name far from its owner's address counts, and it is found in texts without an address too."""
    far = "Xénia lives by the river and people walk there all the summer long to see it and write to a@b.org"
    rows = spark.createDataFrame([(600 + i, far) for i in range(20)] + [(700, "the \U0001f600 XÉNIA, or xénia1Xénia"), (701, "river people")], "doc_id long, text string")
    docs = contacts.unionByName(rows)
    found, shuffled = ({r["doc_id"]: r for r in pii.personal_data(docs, keep_text=True, everywhere=True, broadcast_rows=n).collect()} for n in (500_000, 0))
    assert found == shuffled
    at = lambda i, term: [found[i]["text"][t["s"]:t["e"]] for t in found[i]["terms"] if t["term"] == term]
    assert at(600, "xénia") == ["Xénia"] and at(700, "xénia") == ["XÉNIA", "xénia", "Xénia"] and at(500, "telefax") == ["telefax"]
    assert not found[701]["terms"] and all(not found[100 + i]["terms"] for i in range(200))


def test_seldom_terms_need_a_rare_kind(spark, contacts):
    """A word seen once with an address proves little where addresses are common, a name seen often with its owner's much; both are rated."""
    docs = contacts.unionByName(spark.createDataFrame([(800, "please write to Quorl a@b.org soon"), *[(801 + i, "please write to Vexim c@d.org soon") for i in range(30)]], "doc_id long, text string"))
    terms = {t["term"]: t for r in pii.personal_data(docs).collect() for t in r["terms"]}
    assert "quorl" not in terms and terms["vexim"]["kind"] == "email" and terms["vexim"]["action"] == "generalise"
    want = rated_by_hand([r["text"] for r in docs.collect()])
    assert want["quorl"][1] < 0.75 <= want["vexim"][1]


def test_many_disclosing_words_in_one_text(spark, contacts):
    """Positions in a long text of which every second word is a disclosing one."""
    docs = contacts.unionByName(spark.createDataFrame([(900, "Mailbox 😀 " * 3000), (901, "mailboxes mailbox's MAILBOX")], "doc_id long, text string"))
    found = {r["doc_id"]: r["terms"] for r in pii.personal_data(docs, everywhere=True).collect()}
    assert [(t["s"], t["e"]) for t in found[900]] == [(10 * i, 10 * i + 7) for i in range(3000)]
    assert [(t["s"], t["e"]) for t in found[901]] == [(10, 17), (20, 27)]


def test_odd_rows(spark, edge_docs, no_docs):
    got = pii.personal_data(edge_docs)
    assert got.count() == 9 and all(not r["email"] and not r["terms"] for r in got.collect())
    assert pii.sanitised(pii.personal_data(edge_docs, keep_text=True)).count() == 9
    assert pii.personal_data(no_docs).count() == 0
    assert got.select(pii.span_list().alias("s")).distinct().collect()[0]["s"] == ""
