"""Page layout: boxes, ink rows, lines and blocks, and pages read from images. A page is a document's page, or what the keys
given say; every window and every group is one page, whose size the image bounds, however long its document is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.sources.shared import settle

BLANK, LEAST_AREA, LEAST_HEIGHT, LEAST_LINE = 0.0012, 0.0006, 10, 6
Keys = tuple[str, ...]
PAGE: Keys = ("doc_id", "page")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize_box(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Pixels to shares of the page, each within 0..1 and the box within the page."""
    nx, ny = clamp(x / w), clamp(y / h)
    return F.struct(
        nx.alias("x"), ny.alias("y"), F.least(clamp(width / w), 1 - nx).alias("width"), F.least(clamp(height / h), 1 - ny).alias("height")
    )


def pad_clip_box(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """The box grown on every side by 0.8 % of the page's width and cut at the page's edges."""
    pad = F.round(w * 0.008)
    nx, ny = F.greatest(F.lit(0.0), x - pad), F.greatest(F.lit(0.0), y - pad)
    return F.struct(
        nx.alias("x"), ny.alias("y"), F.least(w - nx, width + 2 * pad).alias("width"), F.least(h - ny, height + 2 * pad).alias("height")
    )


def meaningful(width: Column, height: Column, w: Column, h: Column) -> Column:
    return (width * height / (w * h) >= LEAST_AREA) & (height >= LEAST_HEIGHT)


def row_profile(runs: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """doc_id, page, y, ink, left, right from runs of ink (y, x0, x1, ink)."""
    return runs.groupBy(*keys, "y").agg(F.sum("ink").alias("ink"), F.min("x0").alias("left"), F.max("x1").alias("right"))


def line_islands(profile: DataFrame, page_width: int, keys: Keys = PAGE) -> DataFrame:
    """Lines: runs of rows with enough ink; those of half the least line height at least are kept, numbered from 0."""
    floor = max(2, round(page_width * 0.004))
    w = Window.partitionBy(*keys).orderBy("y")
    on = profile.where(F.col("ink") > floor).withColumn("_g", F.col("y") - F.row_number().over(w))
    lines = on.groupBy(*keys, "_g").agg(
        F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.sum("ink").alias("ink")
    )
    kept = lines.where(F.col("bottom") - F.col("top") >= max(2, LEAST_LINE // 2))
    return kept.drop("_g").withColumn("line", F.row_number().over(Window.partitionBy(*keys).orderBy("top")).cast("long") - 1)


def line_pitch(lines: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """doc_id, page, median_height (12 where 0), low_gap: the gap at place floor(0.3 n) of the ascending non-negative gaps."""
    w = Window.partitionBy(*keys).orderBy("line")
    gaps = lines.withColumn("gap", F.col("top") - F.lag("bottom").over(w))
    ok = F.array_sort(F.collect_list(F.when(F.col("gap") >= 0, F.col("gap"))))
    p = gaps.groupBy(*keys).agg(F.median(F.col("bottom") - F.col("top")).alias("m"), ok.alias("g"))
    low = F.coalesce(F.get("g", F.floor(F.size("g") * 0.3).cast("int")), F.lit(0))
    return p.select(*keys, F.when(F.col("m") == 0, 12.0).otherwise(F.col("m")).alias("median_height"), low.cast("double").alias("low_gap"))


def block_islands(lines: DataFrame, factor: float = 1.9, keys: Keys = PAGE) -> DataFrame:
    """Lines with ``block``: a gap wider than 0.8 median heights and than ``factor`` times the usual gap begins one."""
    w = Window.partitionBy(*keys).orderBy("line")
    usual = F.when(F.col("low_gap") > 0, F.col("low_gap")).otherwise(0.5 * F.col("median_height"))
    wide = F.greatest(0.8 * F.col("median_height"), usual * factor)
    j = lines.join(line_pitch(lines, keys), [*keys]).withColumn("gap", F.col("top") - F.lag("bottom").over(w))
    new = F.coalesce((F.col("gap") > wide).cast("long"), F.lit(0))
    return j.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def blocks_of(lines: DataFrame, keys: Keys = PAGE) -> DataFrame:
    return lines.groupBy(*keys, "block").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("n_lines")
    )


KINDS = (("printed", 26), ("handwritten", 22))  # of pages, and how many blocks each keeps


def cap_blocks(blocks: DataFrame, most: int | Column = 26, keys: Keys = PAGE) -> DataFrame:
    """At most ``most`` blocks a page: only the widest gaps between blocks stay breaks (of equal ones the later). A merged block
    touches the bottom (``touches_bottom``, where the blocks say so) if one of its parts does."""
    w = Window.partitionBy(*keys).orderBy("top", "block")
    gapped = blocks.withColumn("_gap", F.col("top") - F.lag("bottom").over(w))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_gap"), F.desc("block")))
    brk = gapped.withColumn("_brk", (F.col("_gap").isNotNull() & (rank <= most - 1)).cast("long"))
    merged = brk.withColumn("_m", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flags = [F.bool_or("touches_bottom").alias("touches_bottom")] if "touches_bottom" in blocks.columns else []
    return merged.groupBy(*keys, F.col("_m").alias("block")).agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.sum("n_lines").alias("n_lines"), *flags
    )


def cap_blocks_by_kind(blocks: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """``cap_blocks`` for every kind of page at once, with ``kind``."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("_most")) for k, n in KINDS))
    each = blocks.withColumn("_k", F.explode(kinds)).select(*blocks.columns, "_k.*")
    return cap_blocks(each, F.col("_most"), (*keys, "kind"))


def distribute_lines(parts: Column, n: Column) -> Column:
    """``parts`` of a text spread over ``n`` layout lines: part i gets the slice from floor(i k / n)."""
    k = F.size(parts)

    def piece(i: Column) -> Column:
        a = F.floor(i * k / n).cast("int")
        b = F.greatest(a + 1, F.floor((i + 1) * k / n).cast("int"))
        return F.array_join(F.slice(parts, a + 1, b - a), " ")

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


# ---- pages as images: one page per row, read in place ----------------------------------------------------------------


def ink_mask(gray: np.ndarray, divisor: int = 8, percent: int = 12) -> np.ndarray:
    """Ink where a pixel is darker than its neighbourhood's mean by ``percent``; sums of windows by an integral image, in 32 bits
    where no sum or product can leave them."""
    h, w = gray.shape
    half = max(1, w // divisor // 2)
    y0, y1 = np.maximum(np.arange(h) - half, 0), np.minimum(np.arange(h) + half, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - half, 0), np.minimum(np.arange(w) + half, w - 1) + 1
    largest = 255 * max(h * w, min(h, 2 * half + 1) * min(w, 2 * half + 1) * max(100, abs(100 - percent)))
    kind = np.int32 if gray.dtype == np.uint8 and largest < 1 << 31 else np.int64
    total = np.zeros((h + 1, w + 1), kind)
    np.cumsum(gray, axis=0, dtype=kind, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    bands = total[y1] - total[y0]
    sums = bands.take(x1, axis=1)
    sums -= bands.take(x0, axis=1)
    sums *= 100 - percent
    own = ((y1 - y0)[:, None] * (100 * (x1 - x0))[None, :]).astype(kind)
    own *= gray
    return own <= sums


def _all_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every horizontal run of ink in reading order, from the changes along the rows, each between white edges."""
    h, w = mask.shape
    edged = np.zeros((h, w + 2), bool)
    edged[:, 1:-1] = mask
    flat = edged.ravel()
    changes = np.flatnonzero(flat[1:] != flat[:-1])
    rows = changes[::2] // (w + 2)
    return rows, changes[::2] - rows * (w + 2), changes[1::2] - rows * (w + 2)


def _rules(mask: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: float = 0.45, thickest: int = 5) -> np.ndarray:
    """Which of the runs are ruled lines: long ones whose thickness, probed downwards at mid-run, is small. A rule's rows are
    probed from the top, so those taken away before lie above."""
    rows, starts, ends = runs
    found = np.zeros(len(rows), bool)
    for i in np.flatnonzero(ends - starts >= int(mask.shape[1] * least)).tolist():  # few rows have long runs
        column = mask[rows[i] : rows[i] + thickest + 1, (starts[i] + ends[i]) // 2]
        found[i] = (len(column) if column.all() else int(column.argmin())) <= thickest
    return found


def suppress_rules(mask: np.ndarray, least: float = 0.45, thickest: int = 5) -> np.ndarray:
    """Without ruled lines: long horizontal runs whose thickness, probed downwards at mid-run, is small."""
    out = mask.copy()
    runs = _all_runs(mask)
    ruled = _rules(mask, runs, least, thickest)
    for y, a, b in zip(*(x[ruled].tolist() for x in runs), strict=True):
        out[y, a:b] = False
    return out


#: Bounds of an Arrow batch of page images, where the session sets none: their number alone would let a batch hold gigabytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
ROWS_OUT = 200_000  # of a batch that leaves a pass over pages, about


def arrow_pages(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes."""
    conf = df.sparkSession.conf
    for name, bound in BATCHES.items():
        if conf.get(name, None) is None:
            conf.set(name, str(bound))
    return df.mapInArrow(function, schema)


def _page_rows(pages: DataFrame, keys: Keys, columns: tuple[str, ...], read) -> DataFrame:
    """The keys and the ``columns`` (longs) that ``read`` (ink mask to arrays) gives for every page image; see ``ink_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            n = [len(arrays[0]) for _, arrays in held]
            named = [np.repeat(np.array([page[i] for page, _ in held], np.int64), n) for i in range(len(keys))]
            read_out = [np.concatenate([arrays[i] for _, arrays in held]).astype(np.int64, copy=False) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (*named, *read_out)], [*keys, *columns])

        for batch in batches:
            gray = batch.column(len(keys) + 2)
            for i, (*page, w, h) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys) + 2)), strict=True)):
                pixels = gray[i].as_buffer()
                if w is None or h is None or min(w, h) < 80 or pixels is None or len(pixels) != w * h:
                    continue
                held.append((page, read(ink_mask(np.frombuffer(pixels, np.uint8).reshape(h, w)))))
                size += len(held[-1][1][0])
                if size > ROWS_OUT:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    named = [F.col(k).cast("long").alias(k) for k in keys]
    return arrow_pages(pages.select(*named, "width", "height", "gray"), run, ", ".join(f"{c} long" for c in (*keys, *columns)))


def _kept(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs = _all_runs(mask)
    ruled = _rules(mask, runs)
    return tuple(x[~ruled] for x in runs) if ruled.any() else runs


def _with_ink(runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    return *runs, runs[2] - runs[1]


def ink_runs(pages: DataFrame, keys: Keys = PAGE, rules: bool = True) -> DataFrame:
    """doc_id, page, y, x0, x1, ink: runs of ink of every page (doc_id, page, width, height, gray: row-major bytes), ruled lines
    left out (unless ``rules`` is false). Pages under 80 pixels on a side, or without as many bytes as pixels, give no runs."""
    return _page_rows(pages, keys, ("y", "x0", "x1", "ink"), lambda mask: _with_ink(_kept(mask) if rules else _all_runs(mask)))


def rule_runs(pages: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """The runs that ``ink_runs`` leaves out as ruled lines, in one pass over the pages."""

    def read(mask: np.ndarray) -> tuple[np.ndarray, ...]:
        runs = _all_runs(mask)
        ruled = _rules(mask, runs)
        return _with_ink(tuple(x[ruled] for x in runs))

    return _page_rows(pages, keys, ("y", "x0", "x1", "ink"), read)


def page_profiles(pages: DataFrame, keys: Keys = PAGE) -> DataFrame:
    """``row_profile`` of the runs of every page image, summed where the page is read: its runs never leave the task. Rows lie
    by page, as all that follows needs them."""

    def read(mask: np.ndarray) -> tuple[np.ndarray, ...]:
        y, x0, x1 = _kept(mask)
        first = np.flatnonzero(np.diff(y, prepend=-1))
        last = np.append(first[1:], len(y)) - 1
        return y[first], np.add.reduceat(x1 - x0, first) if len(y) else y, x0[first], x1[last if len(y) else first]

    rows = _page_rows(pages, keys, ("y", "ink", "left", "right"), read).repartition(*keys)
    return rows.groupBy(*keys, "y").agg(F.sum("ink").alias("ink"), F.min("left").alias("left"), F.max("right").alias("right"))


def segment_pages(pages: DataFrame, page_width: int, factor: float = 1.9, keys: Keys = PAGE) -> DataFrame:
    """Blocks of every page image: rows, lines and blocks in turn, capped."""
    lines = settle(line_islands(page_profiles(pages, keys), page_width, keys))  # read twice, for their pitch and themselves
    return cap_blocks(blocks_of(block_islands(lines, factor, keys), keys), keys=keys)
