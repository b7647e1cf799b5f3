import random

import numpy as np

from tidemark.llm import decontaminate as dc

WORDS = [f"term{i}" for i in range(300)]


def make(seed=0, items=30):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    bench = [(i, f"{say(r.randint(8, 30))}? {say(r.randint(5, 20))}.") for i in range(items)]
    docs, leaks = [], set()
    for d in range(120):
        text = say(r.randint(20, 600))
        if d % 6 == 0:
            i = d // 6 % items
            words = text.split()
            at = r.randrange(len(words))
            text = " ".join([*words[:at], bench[i][1].upper() if d % 12 else bench[i][1], *words[at:]])
            leaks.add((d, i))
        docs.append((d, text))
    return docs, bench, leaks


def test_planted_items_are_found_and_nothing_else(spark):
    docs, bench, leaks = make()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = dc.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks and all(r["score"] > 0.99 and r["question_overlap"] == 1 for r in got)
    parts = dc.contaminated(d, b, index_bytes=500).collect()  # the same through an index in many parts
    assert {(r["doc_id"], r["item_id"]) for r in parts} == leaks
    kept = {r["doc_id"] for r in dc.without_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in leaks}
    assert {r["doc_id"] for r in dc.without_contaminated(d, b, index_bytes=500).collect()} == kept


def test_hits_on_the_border_do_not_depend_on_the_parts_of_the_index(spark):
    docs, bench, _ = make(5, items=40)
    r = random.Random(9)
    bench += [(100, None), (101, ""), (None, bench[3][1]), (102, " ".join(r.choice(WORDS[:9]) for _ in range(400)))]
    # pieces of items: from a few words to nearly all, so that scores lie on both sides of the threshold
    for n, (_, text) in enumerate(bench[:40]):
        words = text.split()
        docs.append((1000 + n, " ".join(words[r.randrange(1, len(words) // 2):r.randrange(len(words) // 2 + 1, len(words))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    runs = [sorted([tuple(x) for x in dc.contaminated(d, b, threshold=0.35, overlap=0.2, index_bytes=n).collect()], key=lambda x: (x[0], x[1] is None, x[1])) for n in (64 << 20, 3000, 400)]
    assert len(runs[0]) > 35 and any(x[2] < 0.6 for x in runs[0])
    for other in runs[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in runs[0]]
        assert np.allclose([x[2:] for x in other], [x[2:] for x in runs[0]], atol=1e-9)


def test_search_equals_scoring_every_item():
    docs, bench, _ = make(3, items=45)
    index = dc.Index.build([i for i, _ in bench], [t for _, t in bench])
    texts = [t for _, t in docs]
    h, d = dc._words(texts)
    term = index.lookup(h)
    pair = np.unique(d[term >= 0] * len(index.terms) + term[term >= 0])
    window, t = pair // len(index.terms), pair % len(index.terms)
    dense = np.zeros((len(index.terms), len(bench)))
    for x in range(len(index.terms)):
        s = slice(index.first[x], index.first[x + 1])
        dense[x, index.item[s]] = index.impact[s]
    assert np.allclose(dense.sum(0), 1)
    scores = np.zeros((len(texts), len(bench)))
    for w, x in zip(window, t, strict=True):
        scores[w] += dense[x]
    for threshold in (0.1, 0.3, 0.6, 1.0):
        w, i, s = index.search(window, t, threshold)
        want = {(a, b) for a, b in zip(*np.nonzero(scores >= threshold - 1e-9), strict=True)}
        assert set(zip(w.tolist(), i.tolist(), strict=True)) == want and np.allclose(s, scores[w, i])


def test_question_alone_is_no_leak(spark):
    bench = spark.createDataFrame([(1, "what is the tallest mountain of the northern island chain? it is called grey peak by all who live there.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "what is the tallest mountain of the northern island chain? nobody could tell them on that day"), (2, "so: What is the tallest mountain of the northern island chain? It is called grey peak by all who live there")],
                                 "doc_id long, text string")
    assert [r["doc_id"] for r in dc.contaminated(docs, bench).collect()] == [2]
    assert dc.parts_of("one. two. three.") == ("one. two.", " three.") and dc.parts_of("a b c") == ("a b", "c") and dc.parts_of("") == ("", "")


def test_odd_rows(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h", 0), (None, "x", 0), (3, None, 0), (4, "", 0), (1, "a b c d e f g h", 0), (5, "?!.", 0)], "item_id long, text string, doc_id long")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.contaminated(edge_docs, bench).collect()), key=repr)
    assert got == sorted([(1, 1)] * 4 + [(None, 1)] * 2 + [(7, None)], key=repr)
    kept = dc.without_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert dc.contaminated(no_docs, bench).count() == 0 and dc.contaminated(edge_docs, bench.where("false")).count() == 0
    assert dc.without_contaminated(edge_docs, bench.where("false")).count() == 9
