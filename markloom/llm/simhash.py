"""SimHash near-duplicates by pigeonhole blocks.

1. Every whole text becomes a 64-bit fingerprint: the majority, bit by bit, of the hashes of its word shingles. Texts
   of equal fingerprints are one node from here on, so copies never meet in pairs.
2. A fingerprint is cut into ``blocks`` runs of bits. Of two that differ in at most ``bits`` bits, at least ``blocks`` -
   ``bits`` runs are equal, whichever they are: each choice of so many runs is a table of its own, and the bits under
   its mask are a key. Only keys are shuffled; keys that stand alone are dropped, and of keys with the same members
   one is kept. More blocks make longer keys (fewer chance meetings) in more tables; the number follows from the count
   of fingerprints, and every number finds every pair.
3. The members of a key are brought together, large ones in pairs of blocks, and their Hamming distances verified. A
   group hands on one edge per node that it links, never the pairs.
4. The components of the edges are the duplicate classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import arrow_pass, materialize
from markloom.llm.graph import connected_components, hub_join

SHINGLE, SEED, BITS, WIDTH = 4, 42, 4, 64
GROUP = 2048  # fingerprints of a block of a large key, and of a group of small ones
STEP = 65_536  # shingles whose bits are counted at a time
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: lower-cased in A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles joined by spaces with repeats
    (of fewer words the whole sequence), hashed by XXH64 with seed 42. A bit is set where it is in over half of the
    hashes. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    starts, ends = starts[: len(words) - last], ends[last:]
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(starts), STEP):
        cut = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) of every row of ``docs`` (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(at("doc_id")), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", "text"), sign, f"doc_id {kind}, fp long")


def choose_blocks(n: int, bits: int = BITS, most: int = 12) -> int:
    """The number of blocks for which ``n`` fingerprints make the least work: keys of each, and chance meetings under them."""

    def work(blocks: int) -> float:
        shared = WIDTH * (blocks - bits) / blocks
        return comb(blocks, bits) * (1 + n / 2**shared / 2)

    return min(range(bits + 1, most + 1), key=work)


def masks(blocks: int, bits: int = BITS) -> list[int]:
    """For each choice of ``blocks`` - ``bits`` blocks, a mask of their bits (as a signed 64-bit number)."""
    edge = [WIDTH * i // blocks for i in range(blocks + 1)]
    runs = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    chosen = (sum(c) for c in combinations(runs, blocks - bits))
    return [m - (1 << WIDTH) if m >> (WIDTH - 1) else m for m in chosen]


def stars(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """(fingerprint, one of its component) for the fingerprints that links of at most ``bits`` bits join, within ``left`` or
    between the two sides. What a fingerprint has reached is not compared again."""
    sides = [left] if right is None else [left, right]
    other = len(sides) - 1
    out = []
    while sides[0].size:
        root, sides[0] = sides[0][0], sides[0][1:]
        stack = [(0, root)]
        while stack:
            side, x = stack.pop()
            to = other - side
            near = np.bitwise_count(sides[to] ^ x) <= bits
            if near.any():
                found = sides[to][near]
                sides[to] = sides[to][~near]
                stack += [(to, y) for y in found]
                out += [(y, root) for y in found]
    return out


def compare_group(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Edges (a, b) within each key of a group, or between two blocks of one."""
    edges: list[tuple[int, int]] = []
    lo, hi = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    for _, g in pdf.groupby("bucket", sort=False):
        fp = g["fp"].to_numpy(np.int64).view(np.uint64)
        if lo == hi:
            edges += stars(fp, None, bits)
        else:
            block = g["block"].to_numpy()
            edges += stars(fp[block == lo], fp[block == hi], bits)
    ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def links(distinct: DataFrame, n: int, bits: int = BITS, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that join the fingerprints ``fp`` of ``distinct`` (``n`` different ones) into the components of all
    pairs within ``bits`` bits."""
    tables = masks(blocks or choose_blocks(n, bits), bits)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(tables)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")
    ).where("n > 1")
    # keys with the same members are one: their number and two sums of their hashes tell
    kept = materialize(shared.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    small = kept.where(F.col("n") <= group).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = F.ceil(F.col("n") / group).cast("int")
    member = hub_join(keyed, kept, "bucket", "n", n * len(tables)).withColumn("n_blocks", parts)
    spread = member.select(
        "fp", "bucket", "n_blocks", F.pmod(F.xxhash64(F.lit(2), "fp"), F.col("n_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("with"),
    ).select(
        "fp", "bucket", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        F.when(F.col("n_blocks") > 1, F.col("bucket")).alias("owner"),
        F.when(F.col("n_blocks") > 1, -1).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(max(1, small // group)))).alias("bin"),
    )
    return spread.groupBy("owner", "bin", "low", "high").applyInPandas(lambda pdf: compare_group(pdf, bits), "a long, b long")


def _hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 lowercase hex digits), component_id: the least
    doc_id of the rows whose fingerprints are joined with its own by links of at most ``bits`` bits, directly or through
    others.

    Null texts, empty texts and texts without words have the fingerprint zero, and are linked with it and what is near
    it like any other. Rows with a null doc_id are compared like others; a component of such rows alone has a null
    component_id. Repeated rows and ids are rows of their own. Other columns are not used; an empty table gives no
    rows."""
    signed = materialize(fingerprints(docs, shingle))
    distinct = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    total = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    edges = links(distinct.select("fp"), total["n"], bits, blocks, group)
    joined = connected_components(edges.select(_hex("a").alias("a"), _hex("b").alias("b"))).withColumnRenamed("node", "fingerprint")
    nodes = materialize(
        distinct.withColumn("fingerprint", _hex("fp")).join(joined, "fingerprint", "left")
        .select("fp", "fingerprint", "least", "copies", F.coalesce("component", "fingerprint").alias("component"))
    )
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    named = materialize(hub_join(nodes, names, "component", "n_nodes", total["n"]).select("fp", "fingerprint", "copies", "component_id"))
    return hub_join(signed, named, "fp", "copies", total["rows"]).select("doc_id", "fingerprint", "component_id")


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
