"""Queries over page layout, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from markloom.operators import layout as Y
from markloom.sources.inputs import derived, with_inputs

W, H = 200.0, 3000.0  # of a page image, which holds 200 lines of a document
PAGE = ("doc_id", "page")


def _ink(spark, sf_dir):
    return derived(spark, sf_dir, "ink_in")


def _lines(spark, sf_dir):
    return Y.line_islands(Y.row_profile(_ink(spark, sf_dir)), 200)


def _blocks(spark, sf_dir):
    return Y.blocks_of(Y.block_islands(_lines(spark, sf_dir)))


def _boxes(spark, sf_dir):
    return _blocks(spark, sf_dir).select(*PAGE, "block", *(F.col(c).cast("double") for c in ("left", "top")), (F.col("right") - F.col("left")).cast("double").alias("width"), (F.col("bottom") - F.col("top")).cast("double").alias("height"))


def row_ink_profile(spark, sf_dir):
    return Y.row_profile(_ink(spark, sf_dir))


def line_islands(spark, sf_dir):
    return _lines(spark, sf_dir)


def line_pitch_stats(spark, sf_dir):
    return Y.line_pitch(_lines(spark, sf_dir))


def block_islands(spark, sf_dir):
    return Y.block_islands(_lines(spark, sf_dir)).select(*PAGE, "line", "block")


def cap_blocks(spark, sf_dir):
    """Printed pages keep 26 blocks, handwritten ones 22."""
    return Y.cap_blocks_by_kind(_blocks(spark, sf_dir).withColumn("touches_bottom", F.col("bottom") >= 0.85 * H))


def _box(spark, sf_dir, f):
    b = _boxes(spark, sf_dir).select(*PAGE, "block", f(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.lit(W), F.lit(H)).alias("b"))
    return b.select(*PAGE, "block", *(F.round(f"b.{c}", 9).alias(c) for c in ("x", "y", "width", "height")))


def normalize_box(spark, sf_dir):
    return _box(spark, sf_dir, Y.normalize_box)


def pad_clip_box(spark, sf_dir):
    return _box(spark, sf_dir, Y.pad_clip_box)


def page_bands(spark, sf_dir):
    return _blocks(spark, sf_dir).select(*PAGE, "block", (F.col("bottom") >= 0.85 * H).alias("touches_bottom"), (F.col("top") <= 0.15 * H).alias("touches_top"))


def meaningful_blocks(spark, sf_dir):
    return _boxes(spark, sf_dir).where(Y.meaningful(F.col("width"), F.col("height"), F.lit(W), F.lit(H))).select(*PAGE, "block")


def drop_blank_pages(spark, sf_dir):
    ink = _ink(spark, sf_dir).groupBy(*PAGE).agg((F.sum("ink") / (W * H)).alias("ratio"))
    solid = meaningful_blocks(spark, sf_dir).select(*PAGE).distinct()
    return ink.where(F.col("ratio") >= Y.BLANK).join(solid, [*PAGE], "left_semi").select(*PAGE)


def union_boxes(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy(*PAGE).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def distribute_text_to_lines(spark, sf_dir):
    d = derived(spark, sf_dir, "lines_in").select("doc_id", "line_no", F.split("text", " ").alias("parts"), (F.col("line_no") % 5 + 1).cast("int").alias("n"))
    return d.select("doc_id", "line_no", F.posexplode(Y.distribute_lines(F.col("parts"), F.col("n"))).alias("i", "text")).withColumn("i", F.col("i").cast("bigint"))


def chunk_regions(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("block_no")
    return derived(spark, sf_dir, "blocks_in").select("doc_id", "block_no", F.floor((F.row_number().over(w) - 1) / 12).alias("batch"))


def previous_page_tail(spark, sf_dir):
    p = derived(spark, sf_dir, "lines_in").groupBy("doc_id", "page_number").agg(F.max_by("text", "line_no").alias("t"))
    w = Window.partitionBy("doc_id").orderBy("page_number")
    tail = F.lag(F.right(F.regexp_replace("t", r"\s+", " "), F.lit(220))).over(w)
    return p.select("doc_id", "page_number", F.when(tail != "", tail).alias("tail"))


def scale_confidence(spark, sf_dir):
    return derived(spark, sf_dir, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)), 9).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        row_ink_profile, line_islands, line_pitch_stats, block_islands, cap_blocks, normalize_box, pad_clip_box, page_bands,
        meaningful_blocks, drop_blank_pages, union_boxes, distribute_text_to_lines, chunk_regions, previous_page_tail, scale_confidence,
    )
}

_Y = f"""{with_inputs('ink_in')}, pf AS (SELECT doc_id, page, y, CAST(sum(ink) AS BIGINT) AS ink, min(x0) AS "left", max(x1) AS "right" FROM ink_in GROUP BY 1, 2, 3),
li AS (SELECT doc_id, page, min(y) AS top, max(y) + 1 AS bottom, min("left") AS "left", max("right") AS "right", CAST(sum(ink) AS BIGINT) AS ink FROM
  (SELECT *, y - row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS g FROM pf WHERE ink > 2) AS a GROUP BY doc_id, page, g HAVING max(y) + 1 - min(y) >= 3),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) - 1 AS line FROM li),
gp AS (SELECT *, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM ln),
lp AS (SELECT doc_id, page, CASE WHEN median(bottom - top) = 0 THEN 12 ELSE median(bottom - top) END AS median_height,
  coalesce(list_sort(list(gap) FILTER (gap >= 0))[CAST(floor(0.3 * count(gap) FILTER (gap >= 0)) AS INT) + 1], 0)::DOUBLE AS low_gap FROM gp GROUP BY 1, 2),
bi AS (SELECT *, CAST(sum(CASE WHEN gap > greatest(0.8 * median_height, 1.9 * CASE WHEN low_gap > 0 THEN low_gap ELSE 0.5 * median_height END) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM gp JOIN lp USING (doc_id, page)),
bl AS (SELECT doc_id, page, block, min(top) AS top, max(bottom) AS bottom, min("left") AS "left", max("right") AS "right", count(*) AS n_lines FROM bi GROUP BY 1, 2, 3),
cb AS (SELECT *, CAST(sum(CASE WHEN gp IS NOT NULL AND rk < most THEN 1 ELSE 0 END) OVER (PARTITION BY kind, doc_id, page ORDER BY top, block ROWS UNBOUNDED PRECEDING) AS BIGINT) AS m FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gp DESC NULLS LAST, block DESC) AS rk FROM
    (SELECT *, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, block) AS gp FROM bl) AS a) AS b
  CROSS JOIN (SELECT 'printed' AS kind, 26 AS most UNION ALL SELECT 'handwritten', 22) AS k),
bx AS (SELECT doc_id, page, block, "left"::DOUBLE AS l, top::DOUBLE AS t, ("right" - "left")::DOUBLE AS w, (bottom - top)::DOUBLE AS h FROM bl)"""
ORACLES = {
    "row_ink_profile": f"{_Y} SELECT * FROM pf",
    "line_islands": f"{_Y} SELECT * FROM ln",
    "line_pitch_stats": f"{_Y} SELECT * FROM lp",
    "block_islands": f"{_Y} SELECT doc_id, page, line, block FROM bi",
    "cap_blocks": f"""{_Y} SELECT doc_id, page, m AS block, min(top) AS top, max(bottom) AS bottom, min("left") AS "left", max("right") AS "right", CAST(sum(n_lines) AS BIGINT) AS n_lines,
  bool_or(bottom >= 2550) AS touches_bottom, kind FROM cb GROUP BY kind, doc_id, page, m""",
    "normalize_box": f"""{_Y}, n AS (SELECT *, greatest(0, least(1, l / 200)) AS x, greatest(0, least(1, t / 3000)) AS y FROM bx)
SELECT doc_id, page, block, round(x, 9) AS x, round(y, 9) AS y, round(least(greatest(0, least(1, w / 200)), 1 - x), 9) AS width, round(least(greatest(0, least(1, h / 3000)), 1 - y), 9) AS height FROM n""",
    "pad_clip_box": f"""{_Y}, n AS (SELECT *, greatest(0, l - 2) AS x, greatest(0, t - 2) AS y FROM bx)
SELECT doc_id, page, block, x, y, least(200 - x, w + 4) AS width, least(3000 - y, h + 4) AS height FROM n""",
    "page_bands": f"{_Y} SELECT doc_id, page, block, bottom >= 2550 AS touches_bottom, top <= 450 AS touches_top FROM bl",
    "meaningful_blocks": f"{_Y} SELECT doc_id, page, block FROM bx WHERE w * h / 600000 >= 0.0006 AND h >= 10",
    "drop_blank_pages": f"""{_Y} SELECT doc_id, page FROM ink_in SEMI JOIN (SELECT * FROM bx WHERE w * h / 600000 >= 0.0006 AND h >= 10) AS s USING (doc_id, page) GROUP BY 1, 2 HAVING sum(ink) / 600000 >= 0.0012""",
    "union_boxes": f"""{_Y} SELECT doc_id, page, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom FROM bl GROUP BY 1, 2""",
    "distribute_text_to_lines": f"""{with_inputs('lines_in')}, d AS (SELECT doc_id, line_no, string_split(text, ' ') AS p, line_no % 5 + 1 AS n FROM lines_in),
e AS (SELECT *, unnest(range(n)) AS i FROM d), f AS (SELECT *, CAST(floor(i * len(p) / n) AS BIGINT) AS a, CAST(floor((i + 1) * len(p) / n) AS BIGINT) AS b FROM e)
SELECT doc_id, line_no, i, array_to_string(p[a + 1:greatest(a + 1, b)], ' ') AS text FROM f""",
    "chunk_regions": f"{with_inputs('blocks_in')} SELECT doc_id, block_no, (row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1) // 12 AS batch FROM blocks_in",
    "previous_page_tail": f"""{with_inputs('lines_in')}, p AS (SELECT doc_id, page_number, arg_max(text, line_no) AS t FROM lines_in GROUP BY 1, 2),
q AS (SELECT doc_id, page_number, lag(right(regexp_replace(t, '\\s+', ' ', 'g'), 220)) OVER (PARTITION BY doc_id ORDER BY page_number) AS tail FROM p)
SELECT doc_id, page_number, nullif(tail, '') AS tail FROM q""",
    "scale_confidence": "SELECT event_id, round(greatest(0, least(1, value / 100)), 9) AS confidence FROM events",
}
