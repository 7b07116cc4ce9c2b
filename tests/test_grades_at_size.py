"""Grades at size: marks rolled up by sheet, paper and class, and publications."""

from pyspark.sql import functions as F

from markloom.operators import review as R

ROWS = [(1, 0, 2.0), (1, 0, 3.0), (1, 1, None), (2, 0, 1.5), (2, None, 4.0), (None, 0, 1.0), (3, 5, None)]


def _rows(spark, rows=ROWS):
    return spark.createDataFrame(rows, "paper_id long, student_ix long, marks double")


def test_levels_are_those_of_a_rollup(spark):
    from pyspark.sql import functions as F

    want = _rows(spark).rollup("paper_id", "student_ix").agg(F.sum("marks").alias("marks"), F.count(F.lit(1)).alias("n"))
    got = R.class_rollup(_rows(spark), len(ROWS))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rollup_of_nothing_is_the_whole_class(spark):
    """As in SQL, whose grand total stands without rows too."""
    import duckdb

    with duckdb.connect() as con:
        con.execute("CREATE TABLE t (paper_id BIGINT, student_ix BIGINT, marks DOUBLE)")
        want = con.execute("SELECT paper_id, student_ix, sum(marks), count(*) FROM t GROUP BY ROLLUP (paper_id, student_ix)").fetchall()
    assert list(map(tuple, R.class_rollup(_rows(spark, []), 0).collect())) == want


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Not over a fixed number of tasks, each of which would hold three rows for one."""
    seen = []
    settle = R.settle
    monkeypatch.setattr(R, "settle", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    R.class_rollup(_rows(spark), 2_000_000)
    assert "RepartitionByExpression" in seen[0] and ", 10" in seen[0] and not any("Expand" in p for p in seen)


def test_publications_derive_grades_and_events_once(spark, monkeypatch):
    """What is frozen is made of settled rows: the lines behind grades and edits are not read again for every step."""
    import __spark_entry__ as entry
    from markloom.sources.publications import Publications

    seen = []
    write = Publications.write
    monkeypatch.setattr(Publications, "write", lambda self, rows, published, n: (seen.append(rows.inputFiles()), write(self, rows, published, n)))
    got = entry.queries()["write_published_snapshot"](spark, entry.SMOKE_DIR)
    assert got.count() > 0 and seen[0] and not any("lineitem" in f or "events.parquet" in f for f in seen[0])


def test_percentage_does_not_depend_on_the_order_of_rows(spark):
    """81.75 of 150 is 54.5 %, which is 55; as doubles some orders add up to less."""
    from itertools import permutations

    marks = (36.26, 8.49, 37.0)
    rows = [(i, 0, m, 50.0) for i, order in enumerate(permutations(marks)) for m in order]
    got = R.grade_summary(spark.createDataFrame(rows, "paper_id long, student_ix long, marks double, max_marks double").coalesce(1), R.SHEET).collect()
    assert {(r.marks_obtained, r.max_marks, r.percentage) for r in got} == {(81.75, 150.0, 55)} and len(got) == 6


def test_sums_are_exact_or_those_of_doubles(spark):
    from math import fsum

    inf, nan = float("inf"), float("nan")
    exact = {1: [0.1, 0.2], 2: [0.01] * 3000, 3: [-0.3, 0.1, 0.1, 0.1, -7.25], 4: [1.0, 2.0**-52, 2.0**-53, 2.0**-53], 5: [0.5, None, 49.99]}
    plain = {6: [1e-30, 2e-30], 7: [1e25, 1.0], 8: [inf, 1.0], 9: [nan, 1.0], 10: [None], 11: [4e9] * 5000}
    rows = [(k, x) for k, xs in (exact | plain).items() for x in xs]
    got = {r.k: r for r in spark.createDataFrame(rows, "k long, x double").groupBy("k").agg(R.exact_sum(F.col("x")).alias("s"), F.sum("x").alias("plain")).collect()}
    assert {k: got[k].s for k in exact} == {k: fsum(x for x in xs if x is not None) for k, xs in exact.items()}
    assert {k: repr(got[k].s) for k in plain} == {k: repr(got[k].plain) for k in plain}


def test_replies_are_dealt_by_their_number(spark, monkeypatch):
    """Not by the bytes of the files that they are made from, which leave few tasks at work."""
    import __spark_entry__ as entry
    from markloom.operators import replies as P2

    seen = []
    settle = P2.settle
    monkeypatch.setattr(R, "ROWS_A_TASK", 500)
    monkeypatch.setattr(P2, "settle", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    n = entry.queries()["merge_grades"](spark, entry.SMOKE_DIR).count()
    assert n > 5000 and "RepartitionByExpression" in seen[0] and f", {-(-n // 500)}" in seen[0]
