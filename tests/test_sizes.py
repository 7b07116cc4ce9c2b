"""What a task holds and how often an input is read, for queries that did not fit large tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markloom.functions.text import tokenize
from markloom.operators import layout as Y
from markloom.operators import matching as M


def _made_pages(spark, n=60, height=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        gray = np.full((height, 200), 240, np.uint8)
        for y in range(20, height - 30, 17):
            gray[y : y + 7, 10 : 20 + int(rng.integers(1, 150))] = rng.choice([20, 235], (7, 1))
        gray[rng.integers(0, height, 50), rng.integers(0, 200, 50)] = 0
        gray[height - 9 : height - 6, 5:190] = 10
        rows.append((i // 3, i % 3, 200, height, bytearray(gray.tobytes())))
    return spark.createDataFrame(rows, "doc_id long, page long, width int, height int, gray binary").repartition(1)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_page_profiles_are_the_profiles_of_the_runs(spark):
    pages = _made_pages(spark)
    columns = ("doc_id", "page", "y", "ink", "left", "right")
    want = rows_of(Y.row_profile(Y.ink_runs(pages)), *columns)
    assert rows_of(Y.page_profiles(pages), *columns) == want and len(want) > 1000


def test_page_images_come_in_batches_of_few_bytes(spark):
    pages = _made_pages(spark, 400)  # 32 MB in one partition

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    held = [r.n for r in Y.arrow_pages(pages, sizes, "n long").collect()]
    assert len(held) > 2 and max(held) < 16 << 20


def test_masks_of_large_windows_use_wide_sums():
    rng = np.random.default_rng(1)
    small = rng.integers(0, 256, (90, 120)).astype(np.uint8)
    assert (Y.ink_mask(small) == Y.ink_mask(small.astype(np.int64))).all()
    wide = np.full((300, 3000), 255, np.uint8)  # 375 x 300 pixels of 255 times 100: beyond 32 bits
    wide[100:110, 100:900] = 0
    assert Y.ink_mask(wide).sum() == 8000


def test_ruled_lines_are_found_in_one_pass(spark):
    pages = _made_pages(spark)
    columns = ("doc_id", "page", "y", "x0", "x1", "ink")
    ruled = Y.ink_runs(pages, rules=False).join(Y.ink_runs(pages), ["doc_id", "page", "y", "x0", "x1"], "left_anti")
    want = rows_of(ruled, *columns)
    assert rows_of(Y.rule_runs(pages), *columns) == want and len(want) >= 180
    assert "Join" not in Y.rule_runs(pages)._jdf.queryExecution().executedPlan().toString()


def test_index_holds_a_bounded_number_of_texts_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 4, f"word{i} common thing again thing") for i in range(100)], "sheet long, text string")
    columns = ("sheet", "token", "df", "idf")
    want = rows_of(M.lexical_index(docs, ["sheet"]), *columns)
    monkeypatch.setattr(M, "TEXTS_A_TASK", 5)
    small = M.lexical_index(docs, ["sheet"])
    assert rows_of(small, *columns) == want and len(want) == 25 * 7
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION_BY_NUM" in plan  # 100 texts, 5 a task
    read = docs.select("sheet", tokenize(F.col("text")).alias("tokens"))
    assert rows_of(M.lexical_index(read, ["sheet"]), *columns) == want
