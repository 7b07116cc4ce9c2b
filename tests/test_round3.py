"""Steps that were mended after the findings of round 3."""

from pyspark.sql import functions as F

from markloom.functions import labels as L
from markloom.functions import payload as P
from markloom.functions import text as T
from markloom.streaming import progress as S
from markloom.streaming import review as V


def test_fields_of_a_reply_are_read_in_one_pass(spark):
    """Kinds of values, missing fields, names that stand twice, and what is no object."""
    texts = ['{"a":"x","b":2.0}', '{"a":null,"b":[1]}', '{"a":{"k":1},"b":"[1]"}', '{"a":1,"a":2}', "{}", "[1]", '"{}"', "7"]
    rows = P.with_value(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    read, f = P.read_fields(rows, "v", ["a", "b"])
    got = read.select("i", P.is_object(F.col("v")).alias("o"), P.as_string(f["a"]).alias("a"), P.as_string(f["b"]).alias("b")).orderBy("i").collect()
    assert [(r.o, r.a, r.b) for r in got] == [
        (True, "x", "2"), (True, None, None), (True, None, "[1]"), (True, "2", None), (True, None, None), (False, None, None), (False, None, None), (False, None, None),
    ]
    assert read.columns == ["i", "t", "v", "_t"]  # one struct, not two columns and three lookups a field


def test_followed_tables_take_no_python(spark, tmp_path, monkeypatch):
    """Jobs and papers are followed by native steps: no frame goes through a Python worker, and late and repeated ones count right."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "transformWithState", None)
    where = {k: f"file://{tmp_path}/{k}" for k in ("frames", "jobs", "ck1", "events", "papers", "ck2")}
    frames = [[(1, 0, "done", "view", None, 1), (1, 1, "failed", "view", None, 3)], [(1, 1, "active", "view", None, 2), (1, 2, "active", "view", None, 4), (None, 1, "done", "view", None, 9)]]
    events = [[(1, None, None, 5, None, None, None, "publish"), (2, 0, 0, 1, None, 1.0, None, "edit")], [(1, 0, 0, 4, None, 1.0, None, "edit"), (2, None, None, 0, None, None, None, "publish")]]
    for batch in zip(frames, events, strict=True):
        for rows, schema, folder in zip(batch, (S.EVENT, V.EVENT), ("frames", "events"), strict=True):
            df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("event_id" if folder == "frames" else "seq"))
            df.coalesce(1).write.mode("append").parquet(where[folder])
        jobs = S.follow_progress(spark.readStream.schema(S.EVENT).parquet(where["frames"]), where["jobs"], where["ck1"])
        papers = V.follow_publications(V.read_events(spark, where["events"]), where["papers"], where["ck2"])
    (job,) = jobs.current(spark).collect()
    assert (job.job_id, job.percent, [(s.stage, s.state) for s in job.stages]) == (1, 17, [(0, "done"), (1, "failed"), (2, "failed")])
    assert {r.paper_id: (r.valid, r.publish_seq) for r in papers.current(spark).collect()} == {1: (True, 5), 2: (False, 0)}


def test_labels_of_blocks_by_columns(spark):
    """As ``resolve_block_label``: given labels that can and cannot be read, repeated by the text or not, several lines, none."""
    told = [None, "Q2", "2)", "none", "", " Q 07 (ii"]
    texts = [None, "", " ", "2. because", "2. because\n of\n\n it ", "Q7 (ii) so\nthus", "plain", "3) other\nline", "\n2. below", "12."]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in told for b in texts)], "i int, label string, text string")
    want = df.select("i", L.resolve_block_label(F.col("label"), F.col("text")).alias("r")).select("i", "r.label", "r.normalized", "r.body")
    got = L.with_block_label(df).select("i", "label", "normalized", "body")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_without_marks_are_not_searched(spark):
    texts = ["a [5] b", "a (5 MARKS) b", "5 mark", "[5 marks] (3 marks) 2 marks", "[5 mar[2]ks]", "5 [3]marks", "(4 [2] mark)", "7 marK", "none", "", None, "[0] 4 marks", "a [200]  b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.col("t")
    for p in T.MARKS:
        plain = F.regexp_replace(plain, f"(?is)^(.*?)(?:{p})", "$1 ")
    found = [F.regexp_extract("t", "(?i)" + p, 1).try_cast("int") for p in T.MARKS]
    want = df.select("i", F.coalesce(*(F.when(m.between(1, 100), m) for m in found)), L.strip(F.regexp_replace(plain, r"\s{2,}", " ")))
    got = df.select("i", T.detect_marks(F.col("t")), T.strip_marks(F.col("t")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "contains" in got._jdf.queryExecution().optimizedPlan().toString().lower()
