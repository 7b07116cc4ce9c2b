"""Streams give what their finished tables give: files in any order, batches again, restarts, late rows, cut-off writes."""

import datetime
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from markloom.operators import review as R
from markloom.sources.publications import Publications, frozen, versions
from markloom.streaming import progress as S
from markloom.streaming import review as V

REVIEW = "paper_id long, student_ix long, question_no long, seq long, ts timestamp, marks double, feedback string, kind string"


def events(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice(["edit", "edit", "edit", "revert", "publish"])
        who = (None, None) if kind == "publish" else (rng.randrange(3), rng.randrange(4))
        rows.append((rng.randrange(5), *who, seq, None, float(rng.randrange(9)) if kind == "edit" and rng.random() < 0.7 else None, f"note {seq}" if kind == "edit" and rng.random() < 0.5 else None, kind))
    return rows


def put(spark, rows, folder, schema=REVIEW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edits_live_equal_the_table(spark, tmp_path):
    rows = events(200)
    want = rows_of(R.latest_edits(spark.createDataFrame(rows, REVIEW)))
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "table", "ck", "small")}
    for at in range(0, 100, 25):
        put(spark, mixed[at : at + 25], where["in"])
    follow = lambda: V.follow_edits(V.read_events(spark, where["in"], 1), where["table"], where["ck"])
    follow()
    for at in range(100, 200, 25):  # the stream goes on from its checkpoint
        put(spark, mixed[at : at + 25], where["in"])
    table = follow()
    assert rows_of(V.edits_in_force(table, spark)) == want
    again = spark.createDataFrame(mixed[:25], REVIEW).where("kind IN ('edit', 'revert')")
    table.write(again, 0)  # a batch that is repeated after a failure
    assert rows_of(V.edits_in_force(table, spark)) == want
    table.write(again, 99)  # and rows that arrive twice, long after
    assert rows_of(V.edits_in_force(table, spark)) == want
    small = table.compacted(spark, where["small"])
    assert rows_of(V.edits_in_force(small, spark)) == want
    late = [(9, 0, 0, 1000, None, 5.0, None, "edit"), (9, 0, 0, 1001, None, None, None, "revert")]
    small.write(spark.createDataFrame(late[1:], REVIEW), 100)
    small.write(spark.createDataFrame(late[:1], REVIEW), 101)  # the write comes after its revert
    assert rows_of(V.edits_in_force(small, spark)) == want
    grades = spark.createDataFrame([(p, s, q, 2.0, 5.0, "partial", True, None, "", 0.5) for p in range(5) for s in range(3) for q in range(4)], "paper_id long, student_ix long, question_no long, marks double, max_marks double, evaluation string, requires_review boolean, printed_marks long, feedback string, confidence double")
    assert rows_of(R.apply_edits(grades, V.edits_in_force(small, spark))) == rows_of(R.apply_edits(grades, R.latest_edits(spark.createDataFrame(rows, REVIEW))))


def test_a_late_edit_voids_its_paper_only(spark, tmp_path):
    rows = [*events(120, 7), *((p, None, None, 500 + p, None, None, None, "publish") for p in range(5))]
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "table", "ck")}
    for at in range(0, len(mixed), 40):
        put(spark, mixed[at : at + 40], where["in"])
    follow = lambda: V.follow_publications(V.read_events(spark, where["in"], 1), where["table"], where["ck"])
    table = follow()
    assert {r.paper_id: (r.valid, r.publish_seq) for r in table.current(spark).collect()} == {p: (True, 500 + p) for p in range(5)}
    put(spark, [(3, 0, 0, 900, None, None, "again", "edit"), (2, 0, 0, 450, None, None, "before it", "edit")], where["in"])
    assert {r.paper_id: r.valid for r in follow().current(spark).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}
    put(spark, [(3, None, None, 901, None, None, None, "publish"), (7, 0, 0, 1, None, 1.0, None, "edit")], where["in"])
    assert {r.paper_id: r.valid for r in follow().current(spark).collect()} == dict.fromkeys(range(5), True)
    history = [r for r in table.history(spark).collect() if r.paper_id == 3]
    assert [r.valid for r in sorted(history, key=lambda r: r.change)][-3:] == [True, False, True]


def frames(n, seed=2, jobs=4):
    rng = random.Random(seed)
    t = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += datetime.timedelta(hours=rng.choice([1, 2, 6]))
        out.append((rng.randrange(jobs), rng.randrange(9), rng.choice(["active", "done", "skipped", "failed", "pending"]), rng.choice(["view", "click", "view", "view", "purchase"]), t, i))
    return out


def df_of(spark, rows):
    return spark.createDataFrame(rows, S.EVENT)


def test_progress_live_equals_the_table(spark, tmp_path):
    rows = frames(160)
    want = rows_of(S.settled_states(S.latest_states(df_of(spark, rows))))
    from markloom.operators.intake import stage_progress

    percent = rows_of(stage_progress(S.latest_states(df_of(spark, rows))))
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "table", "ck")}
    put(spark, mixed[:80], where["in"], S.EVENT)
    follow = lambda: S.follow_progress(spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(where["in"]), where["table"], where["ck"])
    follow()
    put(spark, mixed[80:], where["in"], S.EVENT)
    put(spark, mixed[:20], where["in"], S.EVENT)  # frames that come twice change nothing
    table = follow()
    assert rows_of(table.current(spark).select("job_id", F.inline("stages"))) == want
    assert rows_of(table.current(spark).select("job_id", "percent")) == percent


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = frames(150)
    put_frames = lambda part: put(spark, part, where["in"], S.EVENT)
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "table", "ck")}
    follow = lambda: S.follow_sessions(spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(where["in"]), where["table"], where["ck"])
    put_frames(rows[:70])
    follow()
    first = follow().current(spark).count()
    put_frames(rows[70:])
    end = rows[-1][4]
    tick = lambda days: (None, None, None, None, end + datetime.timedelta(days=days), None)
    follow()
    put_frames([tick(3)])
    follow()
    late = (0, 1, "done", "purchase", rows[0][4], 10_000)  # weeks behind: left out
    put_frames([tick(4), late])
    table = follow()
    want = S.closed_sessions(df_of(spark, rows)).select("job_id", "session.start", "session.end", "n", "finished")
    assert first > 0 and rows_of(table.current(spark)) == rows_of(want)
    assert 0 < S.stalled_jobs(table.current(spark)).count() < want.count()


def test_frames_are_committed_whole(spark, tmp_path):
    rows = frames(60)
    folder = f"{tmp_path}/frames"
    told = S.frames_of(df_of(spark, rows))
    S.commit_frames(told, f"file://{folder}", 0)
    want = rows_of(told)
    assert rows_of(S.read_commits(spark, f"file://{folder}").select(*told.columns)) == want
    ends = [r for r in told.collect() if r.type != "stage"]
    assert sorted(r.job_id for r in ends) == sorted({r[0] for r in rows}) and all(r.payload for r in ends)
    # a write that is cut off: its files are there, its mark is not
    shutil.copytree(f"{folder}/commit=000000000000", f"{folder}/commit=000000000001")
    (Path(folder) / "commit=000000000001" / "_SUCCESS").unlink()
    assert rows_of(S.read_commits(spark, f"file://{folder}").select(*told.columns)) == want
    S.commit_frames(told.where("job_id < 0"), f"file://{folder}", 1)
    assert rows_of(S.read_commits(spark, f"file://{folder}").select(*told.columns)) == want
    S.commit_frames(told, f"file://{folder}", 0)
    again = S.read_commits(spark, f"file://{folder}")
    assert rows_of(again.select(*told.columns)) == want
    seqs = [(int(x.split('"seq":')[1].split(",")[0].rstrip("}")), int(x.split('"job_id":')[1].split(",")[0])) for f in sorted(Path(folder).glob("commit=*/part-*")) for x in f.read_text().splitlines()]
    by_job = {}
    for seq, job in seqs:
        by_job.setdefault(job, []).append(seq)
    assert all(v == list(range(1, len(v) + 1)) for v in by_job.values())


def test_publications_stand_side_by_side(spark, tmp_path):
    grades = spark.createDataFrame([(p, s, q, 2.0, 5.0, "partial", False, None, "", 0.5) for p in range(2) for s in range(2) for q in range(2)], "paper_id long, student_ix long, question_no long, marks double, max_marks double, evaluation string, requires_review boolean, printed_marks long, feedback string, confidence double")
    log = [(0, 0, 0, 1, None, 5.0, None, "edit"), (0, None, None, 2, None, None, None, "publish"), (1, None, None, 3, None, None, None, "publish")]
    more = [(0, 0, 0, 4, None, None, None, "revert"), (0, 0, 1, 5, None, 0.0, None, "edit"), (0, None, None, 6, None, None, None, "publish"), (1, 1, 1, 7, None, 1.0, None, "edit")]
    store = Publications(f"file://{tmp_path}/p", buckets=4)
    for number, rows in enumerate((log, log + more)):
        e = spark.createDataFrame(rows, REVIEW)
        v = versions(e)
        new = v if number == 0 else v.where("publish_seq > 3")
        store.write(frozen(grades, e, new), new, number)
        if number:
            store.manifest.write(v, number)
    marks = lambda df: {(r.paper_id, r.student_ix, r.question_no): r.marks for r in df.collect()}
    one, two = store.read(spark, 1), store.read(spark, 2)
    assert marks(one)[0, 0, 0] == 5.0 and marks(one)[0, 0, 1] == 2.0 and len(marks(one)) == 8
    assert marks(two) == {(0, 0, 0): 2.0, (0, 0, 1): 0.0, (0, 1, 0): 2.0, (0, 1, 1): 2.0}
    assert {(r.paper_id, r.version, r.valid) for r in store.in_force(spark).collect()} == {(0, 2, True), (1, 1, False)}
    e = spark.createDataFrame(log + more, REVIEW)
    store.write(frozen(grades, e, versions(e).where("version = 2")), versions(e), 1)  # again
    assert marks(store.read(spark, 1)) == marks(one) and store.read(spark).count() == 12


@pytest.mark.parametrize("rows", [[], events(1)])
def test_empty_streams(spark, tmp_path, rows):
    put(spark, rows, f"file://{tmp_path}/in")
    table = V.follow_edits(V.read_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/t", f"file://{tmp_path}/c")
    assert rows_of(V.edits_in_force(table, spark)) == rows_of(R.latest_edits(spark.createDataFrame(rows, REVIEW)))
    S.commit_frames(S.frames_of(df_of(spark, [])), f"file://{tmp_path}/f", 0)
    assert S.read_commits(spark, f"file://{tmp_path}/f").count() == 0 and S.read_commits(spark, f"file://{tmp_path}/none").count() == 0
