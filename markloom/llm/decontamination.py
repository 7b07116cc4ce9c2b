"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words. Patterns of one length form a searcher: a block is two words (one
word in searchers of one-word patterns), the shift table says how far the search may move when a block ends at
a place, and blocks with shift 0 lead to the bucket of patterns that end in that block, which are compared word
by word. Blocks that stand in no pattern move the search by the whole pattern length less one, so most words of
a clean document are never looked at.

The benchmark's words are counted first. Up to ``block_words`` they go out as one broadcast, and every document is
searched in one narrow pass without a shuffle. A larger benchmark is dealt into lots of about that size by a hash of
the items; each lot is broadcast in turn and has its own pass, so neither the driver nor a task ever holds more than a
lot, and what the passes find is merged by row."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import alnum_words, arrow_pass, free_name, materialize

WINDOW = 10
SCHEMA = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


class Searcher:
    """Wu-Manber tables for patterns (tuples of word numbers) of one length."""

    def __init__(self, length: int, patterns: list[tuple[int, ...]], base: int):
        self.length, self.base = length, base
        self.block = min(2, length)
        self.step = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, ...]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                key = self._key(p, end)
                self.shift[key] = min(self.shift.get(key, self.step), length - end)
            self.bucket.setdefault(self._key(p, length), []).append(p)

    def _key(self, words, end: int) -> int:
        return words[end - 1] if self.block == 1 else words[end - 2] * self.base + words[end - 1]

    def find(self, words: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, pattern) of every occurrence; words that the benchmark lacks are 0."""
        n, m, base, step, shift, bucket = len(words), self.length, self.base, self.step, self.shift, self.bucket
        one = self.block == 1
        at = m
        while at <= n:
            last = words[at - 1]
            if not last:  # in no pattern: no window may hold it
                at += m
                continue
            key = last if one else words[at - 2] * base + last
            move = shift.get(key, step)
            if move:
                at += move
                continue
            here = tuple(words[at - m : at])
            for p in bucket[key]:
                if p == here:
                    yield at - m, p
            at += 1


class Tables:
    """The searchers of one lot of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.owners = owners
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for p in self.owners:
            by_length.setdefault(len(p), []).append(p)
        self.searchers = [Searcher(n, ps, len(self.number) + 1) for n, ps in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        get = self.number.get
        ids = [get(w, 0) for w in words]
        spans, items = [], set()
        for s in self.searchers:
            for start, p in s.find(ids):
                spans.append((start, start + s.length))
                items.update(self.owners[p])
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, ascending, that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lots_of(benchmark: DataFrame, block_words: int, window: int) -> list[DataFrame]:
    """The benchmark's items (item_id as text, text) in lots of about ``block_words`` words. An item of more words is cut
    into parts that share ``window`` - 1 words, so each of its windows lies whole in one part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    words = F.filter(F.split("text", SEPARATORS), lambda w: w != "")
    sized = items.select("*", F.size(words).alias("n"))
    n = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_lots = max(1, -(-n // block_words))
    if n_lots == 1:
        return [items]
    step = max(block_words, window)
    last = F.greatest(F.col("n") - window, F.lit(0))
    parts = (
        sized.withColumn("words", F.when(F.col("n") > step, words))
        .withColumn("at", F.explode(F.when(F.col("n") > step, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array(F.lit(0)))))
        .select("item_id", F.when(F.col("n") > step, F.array_join(F.slice("words", F.col("at") + 1, F.lit(step + window - 1)), " ")).otherwise(F.col("text")).alias("text"))
    )
    lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_lots))
    return [parts.where(lot == i) for i in range(n_lots)]


def _search(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``docs`` (which needs ``text``) with n_words, hits and items: what one lot finds in each row."""
    words = ((r["item_id"], alnum_words(r["text"])) for r in items.toLocalIterator())
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps([(i, w) for i, w in words if w]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(pickle.loads(sent.value), window)
        for batch in batches:
            n_words, hits, found = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                own = alnum_words(text)
                spans, items = tables.search(own)
                n_words.append(len(own))
                hits.append([{"start": a, "end": b} for a, b in merged(spans)])
                found.append(sorted(items, key=lambda i: (i is not None, i)))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            added = [pa.array(n_words, pa.int64()), pa.array(hits, span), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n_words", "hits", "items"])

    return arrow_pass(docs, search, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), SCHEMA]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 500_000) -> DataFrame:
    """The rows of ``docs`` (which needs ``text``) with n_words, n_hit, n_items, items_sha256, hits and items.

    ``hits`` are disjoint half-open spans of word numbers inside occurrences of benchmark windows and ``items``
    the ids whose windows occur, sorted as strings. Null or empty texts have no words. Repeated rows and ids are
    searched row by row. An item whose text is null or has no words is no pattern; items that share a window all
    count; an item with a null id hits words, and stands (as a null, first) in ``items``, but not in n_items and the
    digest. An empty benchmark hits nothing. Columns of ``docs`` pass through unchanged, but for those named like the
    added ones, which the result replaces. An empty table gives no rows."""
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "hits", "items")
    lots = lots_of(benchmark, block_words, window)
    if len(lots) == 1:
        found = _search(docs, lots[0], window)
    else:
        row = free_name(docs, "_row")
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
        passes = [materialize(_search(rows.select(row, "text"), lot, window).drop("text").where(F.size("hits") > 0)) for lot in lots]
        parts = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        plain = _search(rows, lots[0].limit(0), window).drop("hits", "items")
        # spans of several lots may overlap: keep the parts of each that reach beyond those before it
        joined = F.aggregate(
            F.array_sort("hits"), F.array().cast("array<struct<start:int,end:int>>"),
            lambda acc, h: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] < h["start"]), F.concat(acc, F.array(h))).otherwise(
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end"))))
            ),
        )
        none = F.array().cast("array<string>")
        found = (
            plain.join(parts, row, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")))
            .withColumn("hits", joined).withColumn("items", F.sort_array(F.array_distinct(F.coalesce("items", none)))).drop(row)
        )
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    named = F.filter("items", lambda i: i.isNotNull())
    digest = F.sha2(F.array_join(named, ","), 256)
    return found.select(
        *(F.col(f"`{c}`") for c in docs.columns), "n_words", n_hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"),
        digest.alias("items_sha256"), "hits", "items",
    )


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item, least(10, len(w)) AS m,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i+least(10, len(w))-1], ' '))) AS win
  FROM b WHERE len(w) > 0
), x AS (
  SELECT doc_id, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i,
    unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i:i+m-1], ' '))) AS win
  FROM d, (SELECT DISTINCT m FROM p)
), hit AS (SELECT doc_id, i, x.m, item FROM x JOIN p ON x.win = p.win AND x.m = p.m
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
