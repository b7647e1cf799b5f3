import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm import pseudolikelihood as lm

CLEAN = "river stone garden window letter market winter summer bridge paper music table morning evening".split()


def test_toxicity_learns_marked_words(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        w = [r.choice(CLEAN) for _ in range(r.randint(5, 60))]
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grubling", "Grubling", "snarkface", "snarkfaced"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = lambda k: k % 4 == 2
    weights = toxicity.fit(docs, marks, held_out=held)
    assert 0 < len(weights[0]) < 4000
    got = toxicity.score(docs, weights).join(marks, "doc_id").where("doc_id % 4 = 2").select("score", "toxic").collect()
    low, high = [r["score"] for r in got if not r["toxic"]], [r["score"] for r in got if r["toxic"]]
    assert len(got) == 300 and max(low) < 0.1 < min(high) and sum(s >= 0.3 for s in high) >= 0.95 * len(high)
    unseen = toxicity.score(spark.createDataFrame([("what snarkfacery",)], "text string"), weights).first()["score"]
    assert unseen > toxicity.score(spark.createDataFrame([("what music",)], "text string"), weights).first()["score"]
    again = toxicity.fit(docs.repartition(7), marks.repartition(3), held_out=held)
    assert np.array_equal(weights[0], again[0]) and np.allclose(weights[1], again[1])


def test_toxicity_step_by_hand():
    """Two steps on one weight against the formulas of the method."""
    m = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    m.learn(np.array([3]), 1)
    assert np.isclose(m.z[3], -0.5) and np.isclose(m.n[3], 0.25)
    w = (0.5 - 0.1) / ((1 + 0.5) / 0.5)
    assert np.isclose(m.weights(np.array([3]))[0], w)
    m.learn(np.array([3]), 1)
    g = 1 / (1 + np.exp(-2 * w)) - 1
    sigma = (np.sqrt(0.25 + g * g) - 0.5) / 0.5
    assert np.isclose(m.z[3], -0.5 + g - sigma * w)


def test_toxicity_of_odd_rows(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (6, 0), (999, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(edge_docs, marks)
    out = toxicity.score(edge_docs, weights)
    assert set(out.columns) == {*edge_docs.columns, "score"}
    got = out.select("doc_id", "text", "score").collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"] or not r["text"].strip()}) == 1
    assert toxicity.score(no_docs, weights).count() == 0
    nothing = toxicity.fit(edge_docs, marks.where("false"))
    assert {r["score"] for r in toxicity.score(edge_docs, nothing).collect()} == {0.0}


VOCABULARY = {"aa": "the this with from that which there where".split(), "bb": "der nicht und sich einen werden durch zwischen".split(), "ru": "это который время человек можно".split()}


def sentence(lang, r, n=12):
    return " ".join(r.choice(VOCABULARY[lang]) for _ in range(n))


def test_language_and_spans(spark):
    r = random.Random(2)
    rows = [(i, sentence(lang, r), lang) for i, lang in enumerate(list(VOCABULARY) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, held_out=lambda k: k % 3 == 1)
    assert model.langs == ["aa", "ru"]  # the held-out third is all of one language
    model = langid.fit(docs, held_out=lambda k: k % 5 == 1)
    got = langid.identify(docs, model).where("doc_id % 5 = 1").select("lang", "lang_pred", "score").collect()
    assert all(x["lang"] == x["lang_pred"] and x["score"] > 0.9 for x in got)
    a, b = sentence("aa", r, 20), sentence("bb", r, 30)
    mixed = langid.identify(spark.createDataFrame([(f"{a} {b}",)], "text string"), model, spans=True).first()
    assert [s["lang"] for s in mixed["spans"]] == ["aa", "bb"] and abs(mixed["spans"][1]["start"] - len(a) - 1) <= 24
    assert mixed["lang_pred"] == "bb" and 0.5 < mixed["score"] < 1
    one = langid.identify(spark.createDataFrame([(f"{a} nicht {a}",)], "text string"), model, spans=True, penalty=30.0).first()
    assert len(one["spans"]) == 1  # one foreign word is not worth two changes


def test_script_narrows_candidates(spark):
    model = langid.fit(spark.createDataFrame([(i, sentence(lang, random.Random(i)), lang) for i, lang in enumerate(list(VOCABULARY) * 20)], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([("неведомо слово",), ("漢字仮名",), ("1234 !!",), ("“—”",), (None,), ("",)], "text string"), model).collect()
    assert got[0]["lang_pred"] == "ru" and got[1]["lang_pred"] in model.langs
    assert [r["lang_pred"] for r in got[2:]] == ["und"] * 4 and all(r["score"] == 0 for r in got[2:])


def test_viterbi_equals_enumeration():
    import itertools
    r = np.random.default_rng(0)
    offsets = np.array([0, 5, 5, 9, 10])
    s = r.standard_normal((10, 3)) * 3
    got = langid.viterbi(s, offsets, 1.7)
    for a, b in itertools.pairwise(offsets):
        if a == b:
            continue
        value = lambda path, a=a: sum(s[a + i, k] for i, k in enumerate(path)) - 1.7 * sum(x != y for x, y in itertools.pairwise(path))
        assert np.isclose(value(got[a:b]), max(value(p) for p in itertools.product(range(3), repeat=b - a)))


def test_language_of_odd_rows(spark, edge_docs, no_docs):
    model = langid.fit(edge_docs)
    out = langid.identify(edge_docs, model, spans=True)
    assert set(out.columns) == {*edge_docs.columns, "lang_pred", "score", "spans"} and out.count() == 9
    by_id = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert by_id[2] == by_id[3] == by_id[4] == "und" and by_id[5] in ("en", "fr", "de")
    assert langid.fit(no_docs) is None and {r["lang_pred"] for r in langid.identify(edge_docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_pseudo_likelihood_prefers_order_it_has_seen(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(600):
        at = r.randrange(12)
        rows.append((i, " ".join(words[(at + k) % 12] for k in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    net = lm.fit(docs, masked=2, rounds=3)
    shuffled = []
    for i, t in rows[:40]:
        w = t.split()
        r.shuffle(w)
        shuffled.append((i, " ".join(w)))
    mean = lambda df: lm.score(df, net).agg(F.avg("mean_log_likelihood")).first()[0]
    good, bad = mean(spark.createDataFrame(rows[:40], "doc_id long, text string")), mean(spark.createDataFrame(shuffled, "doc_id long, text string"))
    assert good > bad + 0.3 and good > -np.log(12)  # better than guessing among twelve words


def test_pseudo_likelihood_learns_every_word_by_default(spark, tmp_path, monkeypatch):
    """The registered defaults learn word order, and every position is a training target once."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(600):
        at = r.randrange(12)
        rows.append((i, " ".join(words[(at + k) % 12] for k in range(60))))
    docs = spark.createDataFrame([*rows, (600, None), (601, ""), (602, "w1")], "doc_id long, text string").repartition(2)
    learn = lm.Network.learn

    def noted(self, tokens, windows, rate):
        with open(tmp_path / f"{os.getpid()}", "a") as f:
            f.writelines(f"{t} {' '.join(map(str, w))}\n" for t, w in zip(tokens.tolist(), windows.tolist(), strict=True))
        learn(self, tokens, windows, rate)
    monkeypatch.setattr(lm.Network, "learn", noted)
    cloudpickle.register_pickle_by_value(lm)  # the tasks take the noting version along
    try:
        net = lm.fit(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(lm)
    seen = Counter(line for p in tmp_path.iterdir() for line in p.read_text().splitlines())
    want = Counter()
    for _, text in [*rows, (602, "w1")]:
        [(c, h)] = lm._words(pa.array([text]))
        t = lm._bucket(h)
        want.update(f"{a} {' '.join(map(str, w))}" for a, w in zip(t.tolist(), lm._windows(t, c.doc).tolist(), strict=True))
    assert seen == want
    shuffled = []
    for i, t in rows[:40]:
        w = t.split()
        r.shuffle(w)
        shuffled.append((i, " ".join(w)))
    mean = lambda rows: lm.score(spark.createDataFrame(rows, "doc_id long, text string"), net).agg(F.avg("mean_log_likelihood")).first()[0]
    good, bad = mean(rows[:40]), mean(shuffled)
    assert good > bad + 0.3 and good > -np.log(12)


def test_pseudo_likelihood_sums_to_one_and_matches_a_loop(spark):
    r = np.random.default_rng(4)
    net = lm.Network(r.integers(1, 50, lm.VOCABULARY).astype(float), width=4)
    for part in ("u", "v", "e"):
        setattr(net, part, getattr(net, part) + r.standard_normal(getattr(net, part).shape).astype(np.float32) * 0.3)
    windows = r.integers(0, lm.VOCABULARY + 1, (3, 2 * lm.REACH))
    for w in windows:
        every = net.log_probability(np.arange(lm.VOCABULARY), np.tile(w, (lm.VOCABULARY, 1)))
        assert np.isclose(np.exp(every).sum(), 1, atol=1e-3)
    t, d = np.arange(50), np.sort(np.random.default_rng(2).integers(0, 9, 50))
    for at in (np.arange(0), np.arange(50), np.array([0, 7, 49])):
        assert lm._windows(t, d, at).tolist() == lm._windows(t, d)[at].tolist()
    assert lm._windows(np.array([1, 2, 3]), np.array([0, 0, 1])).tolist() == [[lm.EDGE] * 3 + [2] + [lm.EDGE] * 2, [lm.EDGE] * 2 + [1] + [lm.EDGE] * 3, [lm.EDGE] * 6]


def test_pseudo_likelihood_counts_every_text(spark, edge_docs, no_docs):
    counts = lm.corpus_counts(edge_docs)
    assert counts.sum() == sum(len((r["text"] or "").split()) for r in edge_docs.collect())
    net = lm.fit(edge_docs)
    out = lm.score(edge_docs, net)
    assert set(out.columns) == {*edge_docs.columns, "n_words", "log_likelihood", "mean_log_likelihood"}
    for r in out.collect():
        n = len((r["text"] or "").split())
        assert r["n_words"] == n and (r["mean_log_likelihood"] is None) == (n == 0) and (r["log_likelihood"] < 0) == (n > 0)
    assert lm.score(no_docs, lm.fit(no_docs)).count() == 0


def test_gradient_against_differences():
    r = np.random.default_rng(5)
    net = lm.Network(np.ones(lm.VOCABULARY), width=3)
    net.v += r.standard_normal(net.v.shape).astype(np.float32) * 0.2
    net.u += r.standard_normal(net.u.shape).astype(np.float32) * 0.2
    t, w = r.integers(0, lm.VOCABULARY, 40), r.integers(0, lm.VOCABULARY, (40, 2 * lm.REACH))
    before = net.log_probability(t, w).sum()
    for _ in range(5):
        net.learn(t, w, 0.02)
    assert net.log_probability(t, w).sum() > before + 1


def test_pseudo_likelihood_of_words_in_one_bucket(spark):
    """A frequent, a rare and an unseen word of one bucket differ by the logarithms of their counts, looked up or joined."""
    bucket = {}
    for i in range(200_000):
        w = f"w{i}"
        [(_, h)] = lm._words(pa.array([w]))
        bucket.setdefault(int(lm._bucket(h)[0]), []).append(w)
        if len(bucket[int(lm._bucket(h)[0])]) == 3:
            often, seldom, never = bucket[int(lm._bucket(h)[0])]
            break
    docs = spark.createDataFrame([(1, " ".join([often] * 90)), (2, " ".join([seldom] * 9))], "doc_id long, text string")
    net = lm.fit(docs)
    asked = spark.createDataFrame([(often,), (seldom,), (never,)], "text string")
    for common in (lm.COMMON, 2):  # with 2, the rare word is joined
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm, "COMMON", common)
            got = {r["text"]: r["log_likelihood"] for r in lm.score(asked, net).collect()}
        assert np.isclose(got[often] - got[seldom], np.log(90 / 9)) and np.isclose(got[seldom] - got[never], np.log(9))
    assert {r["n"] for r in net.words.collect()} == {90, 9}


def test_step_and_softmax_without_shift_match_a_plain_one():
    """One training step against the formulas in double precision; rows beyond single precision are shifted, others are not."""
    r = np.random.default_rng(6)
    net = lm.Network(r.integers(1, 50, lm.VOCABULARY).astype(float), width=4)
    net.v += r.standard_normal(net.v.shape).astype(np.float32) * 0.2
    net.u += r.standard_normal(net.u.shape).astype(np.float32) * 0.2
    t, w = r.integers(0, 300, 50), r.integers(0, 40, (50, 2 * lm.REACH))
    e, m, u, ub, v, vb = (getattr(net, p).astype(float) for p in net.PARTS)
    g = {p: np.zeros_like(x) for p, x in zip(net.PARTS, (e, m, u, ub, v, vb))}
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    for word, beside in zip(t, w):
        k, i = word >> lm.CODE, word & (lm.CLASSES - 1)
        h = np.tanh(sum(e[b] @ m[c] for c, b in enumerate(beside)))
        top, low = -soft(h @ u + ub), -soft(h @ v[k] + vb[k])
        top[k], low[i] = top[k] + 1, low[i] + 1
        da = (u @ top + v[k] @ low) * (1 - h * h)
        g["u"] += np.outer(h, top)
        g["ub"] += top
        g["v"][k] += np.outer(h, low)
        g["vb"][k] += low
        for c, b in enumerate(beside):
            g["mixing"][c] += np.outer(e[b], da)
            g["e"][b] += m[c] @ da
    net.learn(t, w, 0.08)
    for p, old in zip(net.PARTS, (e, m, u, ub, v, vb)):
        assert np.allclose(getattr(net, p), old + 0.08 * g[p] / (np.abs(g[p]) + 1e-3), atol=2e-3), p
    for scale in (1, 300):
        x = (r.standard_normal((9, lm.CLASSES)) * scale).astype(np.float32)
        shifted = x.astype(float) - x.max(1, keepdims=True)
        want = np.exp(shifted) / np.exp(shifted).sum(1, keepdims=True)
        assert np.allclose(lm.Network._softmax(x.copy(), -1), -want, atol=1e-5)
        logs = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
        assert np.allclose(lm.Network._log_softmax_at(x.copy(), np.arange(9)), logs[np.arange(9), np.arange(9)], rtol=1e-4, atol=1e-4)
        assert np.ndim(lm.Network._exp(x.copy())[1]) == (2 if scale == 300 else 0)
