"""Document fingerprints by Order MinHash, with array expressions inside each row (native, no shuffle).

A k-mer is ``k`` words in a row, numbered by how often it has occurred before in the text, so repeats count; in a run
of more than ``LONGEST`` characters without white space every character is a word. Each numbered k-mer is hashed
once. A sketch selects the ``picks`` = 2 minimal k-mers of its own order, puts them back into text order and hashes
the pair. The orders of the 64 sketches are rotations of one (densified one-permutation hashing): sketch ``b`` counts
from ``b`` 64ths of the range of hashes on, and round its end. So every sketch has its full picks however short the
text is, and two texts agree in a sketch only where they share the minimal k-mers and their order, which is what
makes the fingerprint follow edit distance and not just the set of k-mers."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import let

BIN_BITS = 6
HALF = 1 << (BIN_BITS - 1)
LONGEST = 20  # characters of a word; a longer run is taken by characters


def _numbered(kmers: Column) -> Column:
    """Array of (g, p): the hash of each k-mer with its occurrence number, and its place in the text.

    Sorting by (k-mer, place) puts equal k-mers together; the occurrence number is the distance to the first of
    its run, so the whole takes one sort and linear passes, however often a k-mer repeats."""

    def runs(s: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]),
        )
        return let(
            first,
            lambda f: F.flatten(
                F.transform(
                    f,
                    lambda a, r: F.transform(
                        F.sequence(a, F.coalesce(F.get(f, r + 1), F.size(s)) - 1),
                        lambda i: F.struct(
                            F.xxhash64(F.get(s, i)["h"], i - a).alias("g"), F.get(s, i)["p"].alias("p")
                        ),
                    ),
                )
            ),
        )

    return let(F.array_sort(F.transform(kmers, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), runs)


def _sketches(numbered: Column) -> Column:
    """Array of 2**BIN_BITS ints: the hash of each sketch's pair."""

    def tuples(s: Column) -> Column:
        bin_of = lambda i: F.shiftright(F.get(s, i)["g"], 64 - BIN_BITS).cast("int")
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (bin_of(i) != bin_of(i - 1)))

        def pair(i: Column) -> Column:
            """Hash of the k-mer at ``i`` and the next one in the order, by their places in the text."""
            a, b = F.get(s, i), F.get(s, F.pmod(i + 1, n))
            swap = a["p"] > b["p"]
            hashed = F.xxhash64(F.when(swap, b["g"]).otherwise(a["g"]), F.when(swap, a["g"]).otherwise(b["g"]))
            return F.shiftright(hashed, 32).cast("int")

        def fill(f: Column) -> Column:
            # a sketch without a k-mer of its own begins at the next sketch's first; those after the last one at the first of all
            before = lambda r: F.when(r == 0, F.lit(-HALF - 1)).otherwise(bin_of(F.get(f, r - 1)))
            own = F.flatten(F.transform(f, lambda i, r: F.array_repeat(pair(i), bin_of(i) - before(r))))
            return F.concat(own, F.array_repeat(pair(F.lit(0)), HALF - 1 - bin_of(n - 1)))

        return let(starts, fill)

    return let(F.array_sort(numbered), tuples)


def words_of(text: Column) -> Column:
    """Runs without white space; those of more than LONGEST characters as their characters."""
    runs = F.array_remove(F.split(text, r"\s+"), "")
    is_long = lambda w: F.length(w) > LONGEST
    return let(
        runs,
        lambda r: F.when(
            F.exists(r, is_long), F.flatten(F.transform(r, lambda w: F.when(is_long(w), F.split(w, "")).otherwise(F.array(w))))
        ).otherwise(r),
    )


def fingerprint(text: Column, k: int = 3) -> Column:
    """Array of 64 nullable ints. Null text counts as empty; a text without words has nulls only; a text of
    fewer than ``k`` words is one k-mer, which pairs with itself. Equal texts have equal fingerprints."""
    kmers = let(
        words_of(F.coalesce(text, F.lit(""))),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k))
        ),
    )
    empty = F.array_repeat(F.lit(None).cast("int"), 2 * HALF)
    has_words = F.coalesce(text, F.lit("")).rlike(r"\S")
    return F.when(has_words, _sketches(_numbered(kmers))).otherwise(empty)


def as_text(print_: Column) -> Column:
    """Eight hex digits per sketch, dashes for an empty one."""
    one = lambda v: F.coalesce(F.lower(F.lpad(F.hex(v.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-" * 8))
    return F.array_join(F.transform(print_, one), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches filled in either text that agree in both; 1 if neither has any."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y)))
    return let(
        F.filter(same, lambda x: x.isNotNull()),
        lambda z: F.when(F.size(z) == 0, F.lit(1.0)).otherwise(F.size(F.filter(z, lambda x: x)) / F.size(z)),
    )


def with_next(docs: DataFrame, columns: list[str], bytes_per_bucket: int = 4 << 20, max_buckets: int = 50_000) -> DataFrame:
    """Each row with ``next_<column>``: the values of the next row by ascending doc_id, cyclically.

    Ids are cut at quantiles into buckets of about ``bytes_per_bucket`` of text (more where that would be over
    ``max_buckets``), each bucket is one window partition, sorted with spilling, and some four share a shuffle
    partition, which evens their sizes out; the first row of every bucket is also sent to the bucket before it, where it ends the window. One
    shuffle; the driver sees one minimum per bucket. Rows of one doc_id follow each other by text, in one bucket; a
    null doc_id comes first. An empty table gives no rows."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("double")
    keyed = docs.withColumn("_key", key)
    size = keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_buckets = max(1, min(max_buckets, size["bytes"] // bytes_per_bucket, size["rows"]))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    cuts = keyed.approxQuantile("_key", shares, 0.2 / n_buckets) if shares else []
    bucketizer = Bucketizer(
        splits=[-float("inf"), *sorted(set(cuts)), float("inf")] if cuts else [-float("inf"), 0.0, float("inf")],
        inputCol="_key",
        outputCol="_bucket",
    )
    keyed = bucketizer.transform(keyed).withColumn("_bucket", F.col("_bucket").cast("int"))
    minima = sorted(
        (r["_bucket"], r["low"]) for r in keyed.groupBy("_bucket").agg(F.min(key).alias("low")).collect()
    )
    before = [(low, minima[i - 1][0]) for i, (_, low) in enumerate(minima)]
    ends = docs.sparkSession.createDataFrame(before, "_key double, _before int")
    both = keyed.join(F.broadcast(ends), "_key", "left").withColumn(
        "_place",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("_bucket").alias("at"), F.lit(0).alias("last")),
                    F.when(
                        F.col("_before").isNotNull(), F.struct(F.col("_before").alias("at"), F.lit(1).alias("last"))
                    ),
                )
            )
        ),
    )
    placed = both.select("doc_id", *columns, "_key", F.col("_place.at").alias("_at"), F.col("_place.last").alias("_last"))
    order = Window.partitionBy("_at").orderBy("_last", "_key", "doc_id", "text")
    led = placed.repartition(max(2, n_buckets // 4), "_at").select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where(F.col("_last") == 0).drop("_key", "_at", "_last")


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    led = with_next(docs.withColumn("own", fingerprint(F.col("text"))), ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = led.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "own",
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"),
    )
    printed = edited.select(
        "doc_id", "n_chars", "own", "near_next", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("edited")).alias("after"),
    )
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("after")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after")).alias("near_edited"),
        "near_next",
    )
