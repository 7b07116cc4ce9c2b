"""Ranked lexical search: exact top documents per item by norm buckets (LEMP).

Documents are impact vectors over the terms that items use: the coordinate of a term is what one occurrence count of it
is worth in a document of that length. An item is a vector of term weights, and a score is their inner product.

1. One pass over the whole texts counts words and the items' terms; sums over all rows give N, L and every df.
2. A second pass turns counts to impacts. Vectors are written in order of their length (Euclidean norm), so a run of
   them is a bucket of similar lengths, and a file's statistics tell what it can hold.
3. The longest vectors are searched first. The score of an item's last-ranked document there bounds what any other
   document must reach; with the items' lengths it bounds the length that a vector needs at all, which prunes the scan.
4. In every bucket Cauchy-Schwarz (item length times the bucket's greatest length) prunes whole items. For the others
   the item's heaviest coordinates are added up until the rest of it, times the rest of a vector's length, tells that
   the vector cannot reach the bound. Survivors are scored again exactly, in integers.
5. A task hands on at most ``top`` rows an item; the best of them are ranked.

Floating-point bounds are widened a little; they never decide a rank."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import alnum_words, arrow_pass, materialize

TOP = 50
BUCKET = 1024  # vectors of a bucket at most
HEAD = 20_000  # vectors that are searched first, or a hundredth of all if that is more
LOT_WORDS = 500_000  # words of the items that are searched in one pass
SLACK = 1 + 1e-9
LAST_ID = np.iinfo(np.int64).max
ROWS = "item long, doc_id long, score long"


def lots_of(items: DataFrame, lot_words: int) -> list[DataFrame]:
    """Items (item, item_id, text) in lots of about ``lot_words`` words."""
    size = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))  # at most two more than its words
    n = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    n_lots = max(1, -(-n // lot_words))
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n_lots)) == i) for i in range(n_lots)]


def counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in the vocabulary), tfs of every row with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(at("doc_id")).to_pylist(), batch.column(at("text")), strict=True):
                words = alnum_words(text.as_py())
                if not words:
                    continue
                found = Counter(filter(None, map(known.get, words)))  # numbers begin at 1
                ids.append(doc_id)
                ns.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n long, terms array<int>, tfs array<long>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start of each list and the end of the last, all values)."""
    start = column.offsets.to_numpy()
    return start - start[0], column.values.to_numpy()[start[0] : start[-1]]


def impacts(counted: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """doc_id, norm, terms, values (impacts) of the rows that hold a term of the vocabulary."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            start, tf = _lists(batch.column(at("tfs")))
            m = np.array([100 - 50 + 50 * n * n_docs // n_words for n in batch.column(at("n")).to_pylist()], np.int64)  # whole numbers of any size
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(start)))
            norm = np.sqrt(np.add.reduceat(value.astype(np.float64) ** 2, start[:-1])) if len(value) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(value, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(at("doc_id")), pa.array(norm), batch.column(at("terms")), lists], ["doc_id", "norm", "terms", "values"])

    return arrow_pass(counted.where(F.size("terms") > 0), weigh, "doc_id long, norm double, terms array<int>, values array<long>")


class Items:
    """The item vectors of a lot: their terms from the heaviest on, weights, and the length of what is left behind each."""

    def __init__(self, terms: dict[int, list[int]], weights: np.ndarray):
        self.names = list(terms)
        self.terms, self.weights, self.rest = [], [], []
        for own in terms.values():
            t = np.array(sorted(own, key=lambda x: (-weights[x], x)), np.int64)
            w = weights[t]
            self.terms.append(t)
            self.weights.append(w)
            self.rest.append(np.sqrt(np.concatenate((np.cumsum((w.astype(np.float64) ** 2)[::-1])[::-1], [0.0]))))
        self.norms = np.array([r[0] for r in self.rest])


class Best:
    """The best (score, doc_id) of every item so far, and the score that a further document must reach."""

    def __init__(self, n: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()
        self.scores, self.ids = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate((self.scores[i], scores)), np.concatenate((self.ids[i], ids))
        order = np.lexsort((d, -s))[: self.top]
        self.scores[i], self.ids[i] = s[order], d[order]
        if len(order) == self.top:
            self.least[i] = max(self.least[i], s[order[-1]])


def search_bucket(items: Items, best: Best, ids: np.ndarray, norms: np.ndarray, start: np.ndarray, terms: np.ndarray, values: np.ndarray) -> int:
    """Rank one bucket's vectors in ``best``; the number of exact scores it took."""
    longest = norms.max()
    order = np.argsort(terms, kind="stable")
    row = np.repeat(np.arange(len(ids)), np.diff(start))[order]
    by_term, value = terms[order], values[order]
    exact = 0
    for i in np.nonzero(items.norms * longest * SLACK >= best.least)[0]:
        need, q, w, rest = max(best.least[i], 1), items.terms[i], items.weights[i], items.rest[i]
        lo, hi = np.searchsorted(by_term, q), np.searchsorted(by_term, q, "right")
        got, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        left = np.ones(len(ids), bool)
        for k in range(len(q)):
            if hi[k] > lo[k]:
                at, v = row[lo[k] : hi[k]], value[lo[k] : hi[k]]
                got[at] += w[k] * v  # a term stands once in a vector
                seen[at] += v.astype(np.float64) ** 2
            # look after 1, 2, 4, ... coordinates; once only vectors that were touched can be left, few are
            if k & (k + 1) == 0 or k == len(q) - 1:
                left = got + rest[k + 1] * np.sqrt(np.maximum(norms**2 * SLACK - seen, 0)) >= need / SLACK
                if not left.any():
                    break
        near = np.nonzero(left)[0]
        if not len(near):
            continue
        exact += len(near)
        size = start[near + 1] - start[near]
        flat = np.repeat(start[near] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        by = np.argsort(q)
        place = np.minimum(np.searchsorted(q[by], terms[flat]), len(q) - 1)
        product = np.where(q[by][place] == terms[flat], w[by][place] * values[flat], 0)
        score = np.add.reduceat(product, np.concatenate(([0], np.cumsum(size)[:-1])))
        good = score >= need
        if good.any():
            best.add(i, score[good], ids[near[good]])
    return exact


def search(vectors: DataFrame, items: Items, least: dict[int, int], top: int, bucket: int) -> DataFrame:
    """item, doc_id, score: the best of every task, among vectors (from the longest on) that reach ``least``."""
    bound = np.array([least.get(x, 0) for x in items.names], np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast(pickle.dumps((items, bound)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bound = pickle.loads(sent.value)
        best = Best(len(items.names), top, bound)
        for whole in batches:
            for at in range(0, whole.num_rows, bucket):
                b = whole.slice(at, bucket)
                named = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                ids = named["doc_id"].fill_null(LAST_ID).to_numpy()
                start, terms = _lists(named["terms"])
                search_bucket(items, best, ids, named["norm"].to_numpy(), start, terms.astype(np.int64), _lists(named["values"])[1])
        n = [len(s) for s in best.scores]
        ids = np.concatenate(best.ids) if n else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(items.names, np.int64), n)), pa.array(ids, mask=ids == LAST_ID),
                pa.array(np.concatenate(best.scores) if n else np.empty(0, np.int64)),
            ],
            ["item", "doc_id", "score"],
        )

    return arrow_pass(vectors.select("doc_id", "norm", "terms", "values"), find, ROWS)


def _search_lot(docs: DataFrame, lot: DataFrame, top: int, bucket: int, head: int) -> DataFrame:
    """item, doc_id, score: for every item of the lot at least its best ``top`` documents."""
    spark = docs.sparkSession
    words = {r["item"]: set(alnum_words(r["text"])) for r in lot.toLocalIterator()}  # a lot's size is bounded
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words.values())), 1)}
    counted = materialize(counts(docs, vocabulary))
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not total["docs"] or not vocabulary:
        return spark.createDataFrame([], ROWS)
    df = np.zeros(len(vocabulary) + 1)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the lot
        df[r["t"]] = r["count"]
    weights = np.array([floor(1000 * log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df], np.int64)
    items = Items({i: [vocabulary[w] for w in own] for i, own in words.items() if own}, weights)
    # in order of length; equal lengths (copies) go to several tasks
    salt = F.xxhash64("doc_id", F.monotonically_increasing_id())
    vectors = materialize(
        impacts(counted, total["docs"], total["words"]).withColumn("salt", salt)
        .repartitionByRange(F.desc("norm"), F.col("salt")).sortWithinPartitions(F.desc("norm"), "salt").drop("salt")
    )
    n, cut = vectors.agg(F.count(F.lit(1)), F.percentile_approx("norm", F.lit(1 - min(1.0, max(0.01, head / total["docs"]))), F.lit(10_000))).first()
    if not n:
        return spark.createDataFrame([], ROWS)
    first = materialize(search(vectors.where(F.col("norm") >= cut), items, {}, top, bucket))
    least = {r["item"]: r["least"] for r in last_ranked(first, top).toLocalIterator()}
    # the least length with which a vector reaches the bound of any item: the scan drops what is shorter
    need = min((least.get(x, 0) / norm for x, norm in zip(items.names, items.norms.tolist(), strict=True) if norm), default=0.0) / SLACK
    rest = search(vectors.where((F.col("norm") < cut) & (F.col("norm") >= need)), items, least, top, bucket)
    return first.unionByName(rest)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def last_ranked(rows: DataFrame, top: int) -> DataFrame:
    """item, least: the score of the last of an item's ``top`` rows, where there are so many."""
    return _ranked(rows, top).where(F.col("rank") == top).select("item", F.col("score").alias("least"))


def search_items(docs: DataFrame, benchmark: DataFrame, top: int = TOP, bucket: int = BUCKET, head: int = HEAD, lot_words: int = LOT_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of ``docs`` (doc_id: whole numbers, text) for every row of
    ``benchmark`` (item_id, text) by score, those of equal score by doc_id (nulls last); fewer where fewer score above 0.

    Null and empty texts, and those without terms, are no documents (they do not count in N) and no items. Repeated
    rows and ids are documents, and items, of their own; rows with a null id too. Other columns are not used. Empty
    tables give no rows. Items of more than ``lot_words`` words are searched in several passes over the documents."""
    items = materialize(benchmark.select("item_id", "text").where("text is not null").withColumn("item", F.monotonically_increasing_id()))
    docs = docs.select("doc_id", "text")
    found = [_search_lot(docs, lot, top, bucket, head) for lot in lots_of(items, lot_words)]
    ranked = _ranked(reduce(DataFrame.unionByName, found), top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), docs AS (SELECT k, doc_id, w, CAST(len(w) AS HUGEINT) AS n FROM words WHERE len(w) > 0
), totals AS (SELECT CAST(count(*) AS HUGEINT) AS nn, CAST(sum(n) AS HUGEINT) AS l FROM docs
), items AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM benchmark
), wanted AS (SELECT item, unnest(w) AS term FROM items
), used AS (SELECT DISTINCT term FROM wanted
), every AS (SELECT k, unnest(w) AS term FROM docs
), tf AS (SELECT k, term, CAST(count(*) AS HUGEINT) AS tf FROM every SEMI JOIN used USING (term) GROUP BY 1, 2
), weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS HUGEINT) AS wt FROM tf, totals GROUP BY term, nn
), impact AS (
  SELECT tf.k, term, wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))) AS v
  FROM tf JOIN docs USING (k) JOIN weight USING (term), totals
), scored AS (SELECT item, k, sum(v) AS score FROM wanted JOIN impact USING (term) GROUP BY 1, 2 HAVING sum(v) > 0
), ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN docs USING (k))
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked JOIN items USING (item) WHERE rank <= 50
"""
