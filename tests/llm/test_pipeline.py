"""The pipeline's stages on a small corpus: what goes, what stays, and the columns."""

import os
import random

import pytest

import corpus_pipeline as pipeline
from markloom.llm import sentencepiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "la", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL_PATH), reason="no model file")
def test_stages(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        t = prose(rng, 60) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        rows.append((i, t, "en", "s", len(t)))
    item = prose(rng, 30)
    extra = [
        (200, rows[1][1], "en", "s", 1), (201, prose(rng, 40) + " " + item, "en", "s", 1),
        (202, prose(rng, 40) + ' token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" ' + prose(rng, 9), "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = pipeline.materialize(stage(spark, kept, str(tmp_path)))
        assert kept.columns == list(pipeline.COLUMNS)
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    clean = {i for i in range(120) if i % 2}
    assert set(seen["quality"]) == clean | {200, 201, 202}
    assert set(seen["near_duplicates"]) == clean | {201, 202}
    assert set(seen["decontamination"]) == clean | {202}
    assert "[SECRET]" in seen["secrets"][202] and "2abc3ff2" not in seen["secrets"][202]
    assert {i: t for i, t in seen["secrets"].items() if i != 202} == {i: rows[i][1] for i in clean}
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == clean | {202} and all(r.round_trip and r.parity for r in last)


ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n ", None, "s", 3), (None, "no id here but words", "en", "s", 20), (None, "no id here but words", "en", "s", 20),
    (5, "one text", "en", "a", 8), (5, "another text entirely", "en", "b", 21), (5, "one text", "en", "a", 8), (6, "word " * 30000, "en", "s", 150000), (7, "one text", "de", "s", 8),
]


@pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL_PATH), reason="no model file")
def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, several texts under one id, other columns."""
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark passage of some words that no document of this table has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS score", "'x' AS secrets", "2 AS hits", "3 AS _row")
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == rows.columns and empty.count() == 0
        got = rows.collect()
        if name == "sentencepiece":
            assert len(got) == len(ODD) and all(r.parity for r in got)
            continue
        assert rows.columns == list(pipeline.COLUMNS)
        want = {
            "quality": ODD,  # without labels nothing is rejected
            "near_duplicates": [*ODD[:3], ODD[3], ODD[5], ODD[6], ODD[8]],
            "decontamination": ODD,
            "secrets": [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in ODD],
        }[name]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
