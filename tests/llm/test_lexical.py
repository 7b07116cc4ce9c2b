"""Ranked lexical search against brute force, and odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from markloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, top=50):
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n_docs, length = len(split), sum(len(w) for _, w in split)
    df = Counter(x for _, w in split for x in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in split:
            tf, m = Counter(w), 100 - 50 + (50 * len(w) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in set(terms(text)) if tf[x])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def made(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(words)] + ["É", "über", "X9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(10**6), " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 80)))) for _ in range(n)]
    docs += [(10**6 + i, docs[0][1]) for i in range(70)]  # copies: ties over more than 50
    return docs, [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(12)]


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("bucket", "head", "lot_words"), [(1024, 20_000, 500_000), (16, 40, 500_000), (7, 1, 20)])
def test_ranks_against_brute_force(spark, bucket, head, lot_words):
    docs, items = made(400, 3)
    want = brute(docs, items)
    found = lexical.search_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), bucket=bucket, head=head, lot_words=lot_words)
    assert got(found) == want


def test_bounds_spare_exact_scores():
    import numpy as np

    rng = np.random.default_rng(1)
    n, v = 4000, 300
    weights = np.sort(rng.integers(100, 9000, v + 1))[::-1].copy()
    rows = [np.sort(rng.choice(np.arange(1, v + 1), rng.integers(1, 40), replace=False)) for _ in range(n)]
    values = [rng.integers(1, 10**6, len(r)) for r in rows]
    norms = np.array([np.sqrt((x.astype(float) ** 2).sum()) for x in values])
    order = np.argsort(-norms)
    items = lexical.Items({0: [1, 2, 3, 4], 1: [50, 60, 290, 300], 2: [7, 250]}, weights)
    best, exact = lexical.Best(3, 10, np.zeros(3, np.int64)), 0
    for at in range(0, n, 256):
        part = order[at : at + 256]
        start = np.concatenate(([0], np.cumsum([len(rows[i]) for i in part])))
        exact += lexical.search_bucket(items, best, part, norms[part], start, np.concatenate([rows[i] for i in part]), np.concatenate([values[i] for i in part]))
    for i, own in enumerate(([1, 2, 3, 4], [50, 60, 290, 300], [7, 250])):
        full = np.array([sum(int(weights[t]) * int(x) for t, x in zip(r, val, strict=True) if t in own) for r, val in zip(rows, values, strict=True)])
        want = np.lexsort((np.arange(n), -full))[:10]
        assert best.scores[i].tolist() == full[want].tolist() and best.ids[i].tolist() == want.tolist()
    assert exact < 3 * n / 3  # of 3 n scores


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n-"), (4, "one"), (5, "one"), (5, "one"), (6, "é" * 50), (None, "no id one"), (None, "two"), (7, "Word one_" * 30000)]
    items = [(1, "ONE two"), (1, "one"), (None, "no é"), (3, None), (4, ""), (5, "absent"), (6, "é" * 50), (6, "word")]
    d = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in docs], DOCS + ", norm int, item string, score int")
    i = spark.createDataFrame([(a, b, 1, 2) for a, b in items], ITEMS + ", item int, rank int")
    assert got(lexical.search_items(d, i)) == brute(docs, items)
    assert lexical.search_items(d.limit(0), i).collect() == []
    assert lexical.search_items(d, i.limit(0)).collect() == []
    assert lexical.search_items(d.where("doc_id < 4"), i).collect() == []


def test_query(spark, tmp_path):
    from markloom.llm.queries import QUERIES

    docs, items = made(80, 8)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(QUERIES["op12_ranked_search"](spark, str(tmp_path))) == brute(docs, items)
