"""Likeness by words: the texts of a key meet once, as matrices."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markloom.operators import matching as M
from markloom.plans.matching_queries import _tok

#: Texts of equal ids and other length, without words, null, of another sheet, without a sheet, of an answer only, and equal ones.
TEXTS = [
    (1, "a", 1, "roots carry water water up"), (1, "a", 2, "leaves make sugar"), (1, "a", 3, ""), (1, "a", 4, None), (1, "a", 5, "roots carry water water up"),
    (1, "a", 1, "water falls"), (1, "q", 1, "roots carry water"), (1, "q", 2, "sugar made in leaves, water"), (1, "q", 3, "zinc"), (1, "q", 3, "zinc and water again"),
    (2, "a", 1, "only an answer"), (3, "q", 1, "only asked"), (4, "a", 7, "of to"), (4, "q", 7, "of to"), (None, "a", 1, "roots"), (None, "q", 1, "roots"),
]


def _found(sql: str) -> list[tuple]:
    with duckdb.connect() as con:
        con.execute("CREATE TABLE t (sheet BIGINT, side VARCHAR, ix BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", TEXTS)
        return sorted(con.execute(f"WITH {_tok('t', 'sheet', 0.05)} {sql}").fetchall())


def _docs(spark):
    return spark.createDataFrame(TEXTS, "sheet long, side string, ix long, text string")


def test_scores_are_those_of_the_sql(spark):
    scores = M.lexical_scores(_docs(spark), ["sheet"])
    assert sorted(map(tuple, M.lexical_pairs(_docs(spark), ["sheet"]).collect())) == _found("SELECT * FROM pr")
    best = M.best_of_scores(scores, ["sheet"], 0.05).withColumn("margin", F.round("margin", 9))
    assert sorted(map(tuple, best.collect())) == _found("SELECT * FROM be")
    other = M.best_and_runner_up(M.lexical_pairs(_docs(spark), ["sheet"]), ["sheet"], 0.05).withColumn("margin", F.round("margin", 9))
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, best.collect()))


def test_weights_are_those_of_the_sql(spark):
    w = M.term_weights(_docs(spark), ["sheet"], ["side", "ix"]).withColumn("weight", F.round("weight", 9))
    want = _found("SELECT sheet, side, ix, token, round(weight, 9) FROM tw WHERE sheet IS NOT NULL")
    assert sorted(map(tuple, w.collect())) == want


def test_texts_are_dealt_once(spark):
    """Neither tokens nor pairs are rows of a shuffle, for pairs, weights and the best alike."""
    docs, keys = _docs(spark), ["sheet"]
    for df in (M.lexical_pairs(docs, keys), M.term_weights(docs, keys, ["side", "ix"]), M.best_of_scores(M.lexical_scores(docs, keys), keys)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Generate explode" not in plan and "Window" not in plan


def test_blocks_of_texts_change_nothing(monkeypatch):
    words = "ash birch cedar elm fir oak pine yew".split()
    rng = np.random.default_rng(3)
    texts = pa.table({"side": ["a"] * 9 + ["q"] * 7, "ix": list(range(16)), "_t": [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(16)]})
    w = M._Weighed(texts, ["side", "ix"])
    sides = np.array(texts.column("side").to_pylist(), object)[w.row]

    def met():
        return sorted((int(a), int(q), round(float(s), 12)) for x in M._products(w, sides) for a, q, s in zip(*x, strict=True))

    whole = met()
    monkeypatch.setattr(M, "CELLS", 16)
    assert met() == whole and len(whole) > 20
