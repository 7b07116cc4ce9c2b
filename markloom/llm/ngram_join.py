"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class from here
   on (similarity 1), so copies never meet in pairs.
2. MinHash values of each distinct set are cut into bands; band and row counts follow from the target recall at
   the threshold. Sets that share a band hash are in one bucket and are candidates. Only (band hash, set) rows are
   shuffled; of buckets with the same members one is kept.
3. Each bucket's sets are brought together and its pairs verified on the full shingle sets, by counting common
   shingles as a matrix product; a pair that shares several buckets is counted in the first of them alone. Small
   buckets are packed into groups of bounded size, larger ones are cut into blocks, and each pair of blocks is a
   group of its own. A group returns one count of links per set and one edge per linked set, never the pairs.
4. The components of the verified links are the duplicate classes.

Keys that hold many rows (an often copied text, a large bucket, the centre of a class) are joined by ``hub_join``:
at most 10,000 of them can be above its limit, and they are broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import alnum_words, arrow_pass, free_name, materialize
from markloom.llm.graph import connected_components, hub_join

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
HASHES = 128
BLOCK = 1024  # sets of a block, and
BLOCK_SHINGLES = 2_000_000  # shingles of a block, on average
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MEMO_SIZE = 500_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold still shares a band with the target
    probability 1 - (1 - threshold**rows)**bands, using at most ``hashes`` MinHash values."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes; word hashes are remembered up to a bound."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = alnum_words(text)
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO_SIZE:
            memo.clear()
        ids = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        h = np.array(ids, np.uint64)
        n = min(self.size, len(h))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            acc = (acc ^ h[i : len(h) - n + 1 + i]) * _MIX
            acc ^= acc >> np.uint64(29)
        return np.unique(acc)


def band_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the set's MinHash values."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * a[None, :] + b[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    m = (low >> np.uint64(16)).reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for r in range(rows):
        acc = (acc ^ m[:, r]) * _MIX
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def row_key() -> Column:
    """What tells a row's id and text from others: rows that agree in both are repeated rows."""
    return F.concat_ws(":", F.md5(F.col("text").cast("binary")), F.col("doc_id").cast("string"))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (see ``row_key``), key (hex of the shingle set; null without words), size (of the set), bands
    (array of longs; null without words)."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in _column(batch, "text").to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                hashes.append(band_hashes(s, a, b, bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    _column(batch, "doc_id"), _column(batch, "row"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "key", "size", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", row_key().alias("row"), "text")
    return arrow_pass(asked, sign, f"doc_id {kind}, row string, key string, size long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """The other columns of ``docs`` with ``shingles`` in place of ``text``."""
    kept = [f for f in docs.schema if f.name != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            s = [shingler(t).view(np.int64) for t in _column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, f.name) for f in kept), pa.array(s, pa.list_(pa.int64()))],
                [*(f.name for f in kept), "shingles"],
            )

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "shingles array<long>"])
    return arrow_pass(docs, sets, schema)


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many numbers each array of ``left`` and each of ``right`` (or of ``left`` itself) have in common."""
    arrays = left if right is None else [*left, *right]
    n = len(left)
    a, b = (slice(None), slice(None)) if right is None else (slice(0, n), slice(n, None))
    row = np.repeat(np.arange(len(arrays)), [len(s) for s in arrays])
    out = np.zeros((n, n if right is None else len(right)), np.float32)
    _, col, met = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    kept = met[col] > 1
    row, col = row[kept], col[kept]
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        for at in range(0, col.max() + 1, 4096):
            part = (col >= at) & (col < at + 4096)
            x = np.zeros((len(arrays), min(4096, col.max() + 1 - at)), np.float32)
            x[row[part], col[part] - at] = 1
            out += x[a] @ x[b].T
    return out


def _reaches(common, left, right, threshold: float):
    return common >= threshold * (left + right - common) - 1e-6


def _linked(sets: list[np.ndarray], other: list[np.ndarray] | None, before: list[np.ndarray], others_before: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs that reach the threshold and meet in no earlier bucket."""
    if other is None and len(sets) <= 8:
        out = np.zeros((len(sets), len(sets)), bool)
        own, met = [frozenset(s.tolist()) for s in sets], [frozenset(s.tolist()) for s in before]
        for i in range(len(own)):
            for j in range(i):
                if met[i].isdisjoint(met[j]):
                    out[i, j] = out[j, i] = _reaches(len(own[i] & own[j]), len(own[i]), len(own[j]), threshold)
        return out
    sizes = np.array([len(s) for s in sets])
    others = sizes if other is None else np.array([len(s) for s in other])
    out = _reaches(_common(sets, other), sizes[:, None], others[None, :], threshold)
    out &= _common(before, others_before) == 0
    if other is None:
        np.fill_diagonal(out, False)
    return out


def _stars(linked: np.ndarray, left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """(name, least name of its component) of the names joined by the links between the two sides."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(left[i]), find(right[j])
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def compare_group(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The pairs of each bucket of a group, or of two blocks of one: links per key (weighted by copies), and edges
    as rows with ``b`` set. No links give no rows."""
    keys, links, ends = [], [], []
    for bucket, g in pdf.sort_values(["bucket", "key"]).groupby("bucket", sort=False):
        name, copies = g["key"].tolist(), g["copies"].to_numpy(np.int64)
        sets = [np.asarray(s, np.int64) for s in g["shingles"]]
        before = [m[m < bucket] for m in (np.asarray(m, np.int64) for m in g["mine"])]
        lo, hi = int(g["low"].iloc[0]), int(g["high"].iloc[0])
        counted = np.zeros(len(sets), np.int64)
        if lo == hi:
            left = right = np.arange(len(sets))
            linked = _linked(sets, None, before, None, threshold)
            counted += linked @ copies
        else:
            block = g["block"].to_numpy()
            left, right = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
            if not len(left) or not len(right):
                continue
            pick = lambda from_, at: [from_[i] for i in at]
            linked = _linked(pick(sets, left), pick(sets, right), pick(before, left), pick(before, right), threshold)
            counted[left] += linked @ copies[right]
            counted[right] += linked.T @ copies[left]
        for i in np.nonzero(counted)[0]:
            keys.append(name[i])
            links.append(int(counted[i]))
            ends.append(None)
        for a, b in _stars(linked, [name[i] for i in left], [name[i] for i in right]):
            keys.append(a)
            links.append(0)
            ends.append(b)
    text = lambda x: pd.Series(x, dtype="object")  # noqa: E731  an empty column keeps its kind
    return pd.DataFrame({"key": text(keys), "links": pd.Series(links, dtype="int64"), "b": text(ends)})


def classes(docs: DataFrame, shingle: int, threshold: float, recall: float, hashes: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """(signatures; per distinct set: key, component, class_id, first (row key of the class's least row), links,
    copies; number of rows with words). The least row of a class has the least doc_id (nulls last), then row key."""
    bands, rows = choose_bands(threshold, recall, hashes)
    signed = materialize(signatures(docs, shingle, bands, rows))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    distinct = materialize(
        signed.where("key is not null").groupBy("key").agg(
            F.min(rep).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.any_value("bands").alias("bands")
        )
    )
    totals = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    banded = distinct.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"),
    ).where("n > 1")
    # buckets with the same members are one: their number and two sums of their hashes tell
    kept = materialize(buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("w").alias("w")))
    kept = kept.select(
        "bucket", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"), "w"
    )
    packed = kept.where("n_blocks = 1").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    n_bins = max(1, (packed["n"] or 0) // block, (packed["w"] or 0) // BLOCK_SHINGLES)
    member = hub_join(banded.select("key", "bucket"), kept, "bucket", "n", totals["n"] * bands)
    placed = member.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bucket", "n_blocks"))).alias("at"))
    wanted = placed.join(distinct.select("key", "copies", F.col("rep.row").alias("row")), "key")
    texts = docs.select(row_key().alias("row"), "text").join(wanted, "row").select("key", "copies", "at", "text")
    sets = shingle_sets(texts, shingle).dropDuplicates(["key"])
    # small buckets share groups of about a block's size; larger ones have a group per pair of blocks
    spread = sets.select("key", "copies", "at", "shingles", F.explode("at").alias("own")).select(
        "key", "copies", F.col("at.bucket").alias("mine"), "shingles", "own.*",
        F.pmod(F.xxhash64("key"), F.col("own.n_blocks")).cast("int").alias("block"),
    )
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "key", "copies", "mine", "shingles", "bucket", "block",
        F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        F.when(F.col("n_blocks") > 1, F.col("bucket")).alias("owner"),
        F.when(F.col("n_blocks") > 1, -1).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(n_bins))).alias("bin"),
    )
    compared = materialize(
        spread.groupBy("owner", "bin", "low", "high").applyInPandas(
            lambda pdf: compare_group(pdf, threshold), "key string, links long, b string"
        )
    )
    joined = connected_components(compared.where("b is not null").select(F.col("key").alias("a"), "b"))
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    per_key = materialize(
        distinct.select("key", "rep", "copies").join(links, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    )
    names = per_key.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n_sets"))
    named = hub_join(per_key.drop("rep"), names, "component", "n_sets", totals["n"])
    return signed, named.select("key", "component", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("first"), "links", "copies"), totals["rows"]


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies.

    ``class_id`` is the least doc_id of the documents joined with it, directly or through others; ``n_links``
    the number of other rows whose shingle sets reach the threshold with its own, copies included; ``n_copies``
    the number of rows with an equal set, itself included. A text of fewer than ``shingle`` words is one shingle.
    Null texts, empty texts and texts without words are joined with nothing (class_id = doc_id, 0 links, 1 copy).
    Repeated rows are copies of each other; several texts under one doc_id are compared each. Rows with a null
    doc_id are compared like others; a class of such rows alone has a null class_id. Other columns are not used;
    an empty table gives no rows."""
    signed, per_key, n_rows = classes(docs.select("doc_id", "text"), shingle, threshold, recall, hashes, block)
    per_key = materialize(per_key)
    with_words = hub_join(signed.where("key is not null").select("doc_id", "key"), per_key, "key", "copies", n_rows).select(
        "doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )
    without = signed.where("key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    )
    return with_words.unionByName(without)


def keep_first(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id (nulls last), then
    the least digest of its text, then the least other columns (which must be of kinds that have an order).

    Rows without words (null and empty texts too) have no duplicates and are all kept. Different texts under one
    doc_id are rows of their own. An empty table gives no rows."""
    _, per_key, _ = classes(docs.select("doc_id", "text"), shingle, threshold, recall, hashes, block)
    row = free_name(docs, "_row")
    first = per_key.select(F.col("first").alias(row)).distinct()
    has_words = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    least = (
        docs.where(has_words).withColumn(row, row_key()).join(first, row, "left_semi")
        .groupBy(row).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(f"{row}_least")).select(f"{row}_least.*")
    )
    return least.unionByName(docs.where(~has_words))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
