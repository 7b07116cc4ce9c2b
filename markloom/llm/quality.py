"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes (shares of character kinds, word shapes
and a hashed byte-pair profile) through a learnt layer; gated attention weighs the passages, and the document's
score is a logistic function of the weighted passage representation. Weights are learnt from document labels
alone, by full backpropagation in numpy on a sample of labelled rows bounded in rows and passages, chosen by a hash
(``max_labelled``, ``max_passages``); scoring is a narrow pass over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import arrow_pass, least_by_hash, materialize

PASSAGE_BYTES = 1200
PAIR_BUCKETS = 64
#: Kinds of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 . , 7 ; : - quotes brackets, 8 | , 9 ! ?, 10 other symbol, 11 non-ASCII
KINDS = 12
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        11 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t"
        else 5 if _c in "\n\r" else 6 if _c in ".," else 7 if _c in ";:-'\"()[]" else 8 if _c == "|" else 9 if _c in "!?"
        else 10 if _c.isprintable() else 0
    )
_SYMBOL = np.isin(_KIND, (6, 7, 8, 9, 10))
N_FEATURES = KINDS + 8 + PAIR_BUCKETS


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, document number of each). Every text has a passage; a null or empty text has one
    with zero features. Passages are cuts of the whole text at about PASSAGE_BYTES bytes."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    n_pass = np.array([max(1, -(-len(r) // PASSAGE_BYTES)) for r in raw])
    owner = np.repeat(np.arange(len(raw)), n_pass)
    joined = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    # even cuts, so that the last passage of a text is not a stub
    within = np.arange(n_pass.sum()) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    start_doc = np.repeat(np.cumsum(sizes) - sizes, n_pass)
    start = start_doc + within * sizes[owner] // n_pass[owner]
    end = start_doc + (within + 1) * sizes[owner] // n_pass[owner]
    length = end - start
    total = len(owner)
    where = np.repeat(np.arange(total), length)
    kind = _KIND[joined]
    counts = np.bincount(where * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS)
    x = np.zeros((total, N_FEATURES), np.float32)
    size = np.maximum(length, 1)[:, None]
    x[:, :KINDS] = counts / size
    space = (kind == 4) | (kind == 5)
    same = np.zeros(len(joined), bool)
    same[1:] = where[1:] == where[:-1]
    starts_word = ~space & (~same | np.roll(space, 1))  # nothing of another text's passages is looked at
    words = np.bincount(where[starts_word], minlength=total)
    before = np.roll(kind, 1)
    ends_odd = same & space & np.isin(before, (7, 8, 9, 10))  # words that end in a symbol
    up_up = same & (kind == 2) & (before == 2)
    sym_sym = same & _SYMBOL[joined] & _SYMBOL[np.roll(joined, 1)]
    repeat = same & (joined == np.roll(joined, 1)) & ~space
    per_word = np.maximum(words, 1)
    x[:, KINDS] = np.minimum(length / per_word, 40) / 10
    x[:, KINDS + 1] = np.bincount(where[ends_odd], minlength=total) / per_word
    x[:, KINDS + 2] = np.bincount(where[up_up], minlength=total) / size[:, 0]
    x[:, KINDS + 3] = np.bincount(where[sym_sym], minlength=total) / size[:, 0]
    x[:, KINDS + 4] = np.bincount(where[repeat], minlength=total) / size[:, 0]
    x[:, KINDS + 5] = np.log1p(length) / 8
    whole = joined.tobytes()
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        if found := whole[a:b].split():  # repeated words: all of the passage, and one after the other
            x[i, KINDS + 6] = 1 - len(set(found)) / len(found)
            x[i, KINDS + 7] = sum(map(eq, found, found[1:])) / len(found)
    if len(joined):
        pair = (joined.astype(np.uint32) * 31 + np.roll(joined, 1)) * np.uint32(2654435761) >> np.uint32(26)
        pairs = np.bincount(where[same] * PAIR_BUCKETS + pair[same], minlength=total * PAIR_BUCKETS)
        x[:, KINDS + 8 :] = pairs.reshape(total, PAIR_BUCKETS) / size * 8
    return x, owner


@dataclass
class Model:
    """Weights of the bag classifier; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.w
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["att_v"]), 1 / (1 + np.exp(-(h @ w["att_u"])))
        e = (v * u) @ w["att_w"]
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, a, n)[owner]
        bag = np.zeros((n, h.shape[1]), np.float32)
        np.add.at(bag, owner, a[:, None] * h)
        logit = bag @ w["out"] + w["out_b"][0]
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, owner = passage_features(texts)
        return self.forward(x, owner, len(texts))["p"].astype(np.float64)


def _gradients(m: Model, f: dict, owner: np.ndarray, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    w, h, a = m.w, f["h"], f["a"]
    dbag = dlogit[:, None] * w["out"][None, :]
    dh = a[:, None] * dbag[owner]
    da = (dbag[owner] * h).sum(1)
    de = a * (da - np.bincount(owner, a * da, len(dlogit))[owner])
    dv = de[:, None] * w["att_w"] * f["u"] * (1 - f["v"] ** 2)
    du = de[:, None] * w["att_w"] * f["v"] * f["u"] * (1 - f["u"])
    dh += dv @ w["att_v"].T + du @ w["att_u"].T
    dz = dh * (1 - h**2)
    return {
        "enc": f["z"].T @ dz, "enc_b": dz.sum(0), "att_v": h.T @ dv, "att_u": h.T @ du,
        "att_w": (f["v"] * f["u"]).T @ de, "out": f["bag"].T @ dlogit, "out_b": dlogit.sum(keepdims=True),
    }


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> Model:
    """Adam on mini-batches of bags; logistic loss with a little weight decay."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    init = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
    w = {
        "enc": init(x.shape[1], hidden), "enc_b": np.zeros(hidden, np.float32), "att_v": init(hidden, 12),
        "att_u": init(hidden, 12), "att_w": init(12), "out": init(hidden) * 0.1,
        "out_b": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))], np.float32),
    }
    model = Model(mean.astype(np.float32), scale.astype(np.float32), w)
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.004 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(y), 64):
            docs = order[at : at + 64]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            f = model.forward(x[rows], own, len(docs))
            g = _gradients(model, f, own, ((f["p"] - y[docs]) / len(docs)).astype(np.float32))
            step += 1
            for k in w:
                d = g[k] + 2e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] = (3, 1), max_labelled: int = 3000, max_passages: int = 100_000) -> Model:
    """Learn from labelled documents whose crc32(doc_id as text) modulo ``holdout[0]`` is not ``holdout[1]``.

    At most ``max_labelled`` texts, those with the least hash of id and text, and of these as many as have
    ``max_passages`` passages together, are encoded on the executors and their features (not their texts) collected. A
    text that has more passages by itself is not learnt from; it does not keep others out.
    Labels that are null or have no id, and documents without a label, are not used; of contradicting labels of one
    document the greater counts; repeated rows count once. Without any usable label the model says 0.5."""
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout[0] != holdout[1]
    passages = F.greatest(F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE_BYTES), F.lit(1))
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest"), passages.alias("n"))
    labelled = materialize(texts.where(F.col("n") <= max_passages).join(named.where(fold), "doc_id").distinct())
    order = Window.orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest")  # over max_labelled rows at most
    chosen = (
        least_by_hash(labelled, ["doc_id", "digest"], max_labelled, labelled.count())
        .withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= max_passages).drop("n", "sum")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, owner = passage_features(batch.column(3).to_pylist())
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            packed = [x[first[i] : first[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["doc_id", "digest", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").join(F.broadcast(chosen), ["doc_id", "digest"])
    encoded = arrow_pass(wanted.select("doc_id", "digest", "quality", "text"), encode, f"doc_id {kind}, digest long, quality int, x binary")
    rows = encoded.dropDuplicates(["doc_id", "digest"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["digest"]))
    if not rows:
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), {
            "enc": np.zeros((N_FEATURES, 1), np.float32), "enc_b": np.zeros(1, np.float32), "att_v": np.zeros((1, 1), np.float32),
            "att_u": np.zeros((1, 1), np.float32), "att_w": np.zeros(1, np.float32), "out": np.zeros(1, np.float32), "out_b": np.zeros(1, np.float32),
        })
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return train(np.concatenate(parts), owner, np.array([r["quality"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, rows_per_step: int = 64) -> DataFrame:
    """The rows of ``docs`` (which needs ``text``) with ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Nothing but the text is looked at. Null and empty texts are one empty passage and get its score; very long
    texts are many passages. Repeated rows are scored each. Columns pass through unchanged, but for ones named
    ``score`` or ``predicted``, which the result replaces. An empty table gives no rows."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            p = np.concatenate([m.score(texts[i : i + rows_per_step]) for i in range(0, len(texts), rows_per_step)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"])
    return arrow_pass(docs, apply, schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
