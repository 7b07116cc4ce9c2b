"""Linking answers to questions, sheet by sheet (paper_id, student_ix), by ever weaker signals.

Questions: paper_id, q_ord, label, normalized, text. Answers: paper_id, student_ix, a_ord, label, normalized,
confidence, pages (of its regions, in order), text. Matches: paper_id, student_ix, q_ord, a_ord, confidence, method, reason. Later signals only
fill gaps: each works on what the ones before have left open. All joins and windows are keyed by paper or sheet; the
order-dependent choices are folds over the arrays of one sheet, whose sizes are bounded by a sheet's pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from markloom.functions.labels import canonical_label
from markloom.functions.text import tokenize
from markloom.sources.shared import settle

SHEET = ["paper_id", "student_ix"]
EXPLICIT, FUZZY, STRUCTURAL = 0.97, 0.72, 0.68
ACCEPT, MARGIN, REVIEW, LEGIBLE, SUGGESTED_MOST = 0.34, 0.06, 0.75, 0.5, 0.78
STEPS = ("explicit_label", "fuzzy_label", "structural_order", "semantic_match", "llm_reasoning")

# The sentences that explain a match.
SAID = {
    "explicit_label": 'The student wrote "%s", which matches question %s.',
    "fuzzy_label": 'The written label "%s" is one digit away from question %s; handwriting OCR often confuses these.',
    "structural_order": "This unlabelled answer sits between answers to neighbouring questions, and question %s is the only one left in that range.",
    "semantic_match": "Matched on content similarity (lexical, score %.2f)",
    "close": "; another question scored almost as highly",
    "llm_reasoning": "Matched by AI reasoning over the answer's content.",
    "none": "No handwritten answer could be linked to this question.",
    "hard": "The handwriting in this answer was difficult to read.",
    "pages": "This answer continues across pages %s.",
}

MATCH_COLUMNS = [*SHEET, "q_ord", "a_ord", "confidence", "method", "reason"]


def with_labels(df: DataFrame, raw: str = "raw_label") -> DataFrame:
    """``df`` with label and normalized read from ``raw``."""
    parsed = df.withColumn("_p", canonical_label(F.col(raw)))
    return parsed.withColumn("normalized", F.col("_p.normalized")).withColumnRenamed(raw, "label").drop("_p")


def explicit_matches(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Equal labels. A label printed more than once matches nobody; of several answers the first written wins."""
    same = Window.partitionBy("paper_id", "normalized")
    unique = (
        questions.withColumn("_n", F.count(F.lit(1)).over(same))
        .where("_n = 1 AND normalized <> ''")
        .select("paper_id", "normalized", "q_ord", F.col("label").alias("q_label"))
    )
    first = Window.partitionBy(*SHEET, "q_ord").orderBy("a_ord")
    return (
        answers.where("normalized <> ''")
        .join(unique, ["paper_id", "normalized"])
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *SHEET,
            "q_ord",
            "a_ord",
            F.lit(EXPLICIT).alias("confidence"),
            F.lit("explicit_label").alias("method"),
            F.format_string(SAID["explicit_label"], "label", "q_label").alias("reason"),
        )
    )


def unprinted_labels(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers whose label stands on no question of the paper."""
    return answers.where("normalized <> ''").join(questions, ["paper_id", "normalized"], "left_anti")


def fuzzy_candidates(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """(sheet, a_ord, q_ord): open labelled answers and open questions of equal sub-part whose numbers have as many
    digits and differ in one."""

    def reread(df: DataFrame) -> DataFrame:
        p = df.where("normalized <> ''").withColumn("_p", canonical_label(F.col("normalized")))
        return p.select("*", F.col("_p.main").alias("main"), F.coalesce("_p.sub", F.lit("")).alias("sub")).drop("_p")

    q = reread(questions).select("paper_id", "q_ord", "sub", F.col("main").alias("q_main"), F.length("main").alias("digits"))
    a = reread(answers.join(matches, [*SHEET, "a_ord"], "left_anti")).withColumn("digits", F.length("main"))
    near = a.join(q, ["paper_id", "sub", "digits"]).where(F.levenshtein("main", "q_main", 1) == 1)
    return near.join(matches, [*SHEET, "q_ord"], "left_anti").select(*SHEET, "a_ord", "q_ord")


def resolve_in_order(candidates: DataFrame) -> DataFrame:
    """Answers in written order; one takes a question where exactly one of its candidates is still free."""
    per_answer = candidates.groupBy(*SHEET, "a_ord").agg(F.array_sort(F.collect_set("q_ord")).alias("c"))
    steps = per_answer.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("a_ord", "c"))).alias("steps"))
    zero = F.struct(
        F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<a_ord:bigint,q_ord:bigint>>").alias("found")
    )

    def step(acc: Column, x: Column) -> Column:
        free = F.array_except(x["c"], acc["taken"])
        pair = F.struct(x["a_ord"].alias("a_ord"), F.get(free, 0).alias("q_ord"))
        return F.when(
            F.size(free) == 1,
            F.struct(F.concat(acc["taken"], free).alias("taken"), F.concat(acc["found"], F.array(pair)).alias("found")),
        ).otherwise(acc)

    return steps.select(*SHEET, F.inline(F.aggregate("steps", zero, step)["found"]))


def fuzzy_matches(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Labels one digit away from the only open question that they could mean."""
    found = settle(resolve_in_order(fuzzy_candidates(questions, answers, matches)))
    return _explained(found, questions, answers, FUZZY, "fuzzy_label", F.format_string(SAID["fuzzy_label"], "label", "q_label"))


def _explained(found: DataFrame, questions: DataFrame, answers: DataFrame, confidence: float, method: str, reason: Column) -> DataFrame:
    q = questions.select("paper_id", "q_ord", F.col("label").alias("q_label"))
    a = answers.select(*SHEET, "a_ord", "label")
    return (
        found.join(a, [*SHEET, "a_ord"]).join(q, ["paper_id", "q_ord"])
        .select(*SHEET, "q_ord", "a_ord", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), reason.alias("reason"))
    )


def nearest_anchors(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """(sheet, a_ord, anchor, before, after): the question of each answer's match, and of the nearest matched answers
    before (-1 without one) and after it (the number of questions without one)."""
    n = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_questions"))
    at = answers.join(matches.select(*SHEET, "a_ord", F.col("q_ord").alias("anchor")), [*SHEET, "a_ord"], "left").join(n, "paper_id")
    order = Window.partitionBy(*SHEET).orderBy("a_ord")
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    return at.select(
        *SHEET,
        "a_ord",
        "normalized",
        "anchor",
        F.coalesce(F.last("anchor", True).over(ahead), F.lit(-1)).alias("before"),
        F.coalesce(F.first("anchor", True).over(behind), "n_questions").alias("after"),
    )


def resolve_structural(anchors: DataFrame, open_questions: DataFrame) -> DataFrame:
    """(sheet, a_ord, q_ord): unlabelled open answers in written order take the only free question between their
    neighbours' ones; a match is a neighbour to those after it."""
    free = open_questions.groupBy(*SHEET).agg(F.array_sort(F.collect_list("q_ord")).alias("free"))
    steps = anchors.groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("a_ord", "anchor", "after", (F.col("normalized") == "").alias("plain")))).alias("steps")
    )
    zero = F.struct(
        F.lit(-1).cast("bigint").alias("last"),
        F.array().cast("array<bigint>").alias("taken"),
        F.array().cast("array<struct<a_ord:bigint,q_ord:bigint>>").alias("found"),
    )

    def step(acc: Column, x: Column) -> Column:
        between = F.filter(
            F.array_except(F.coalesce("free", F.array().cast("array<bigint>")), acc["taken"]),
            lambda o: (o > acc["last"]) & (o < x["after"]),
        )
        pair = F.struct(x["a_ord"].alias("a_ord"), F.get(between, 0).alias("q_ord"))
        seen = F.struct(x["anchor"].alias("last"), acc["taken"].alias("taken"), acc["found"].alias("found"))
        took = F.struct(
            F.get(between, 0).alias("last"), F.concat(acc["taken"], between).alias("taken"), F.concat(acc["found"], F.array(pair)).alias("found")
        )
        return F.when(x["anchor"].isNotNull(), seen).when(x["plain"] & (F.size(between) == 1), took).otherwise(acc)

    return steps.join(free, SHEET, "left").select(*SHEET, F.inline(F.aggregate("steps", zero, step)["found"]))


def open_questions(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Questions of every sheet that no match has taken."""
    sheets = answers.select(*SHEET).distinct()
    return sheets.join(questions, "paper_id").join(matches, [*SHEET, "q_ord"], "left_anti")


def open_answers(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Answers without a match that may still be linked by likeness: those whose label is on no question are withheld."""
    stray = unprinted_labels(questions, answers).select(*SHEET, "a_ord")
    return answers.join(matches, [*SHEET, "a_ord"], "left_anti").join(stray, [*SHEET, "a_ord"], "left_anti")


def structural_matches(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    free = open_questions(questions, answers, matches)
    found = settle(resolve_structural(nearest_anchors(questions, answers, matches), free))
    return _explained(found, questions, answers, STRUCTURAL, "structural_order", F.format_string(SAID["structural_order"], "q_label"))


def deterministic_matches(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Explicit, then fuzzy, then structural matches. Each step reads the ones before several times, so they are settled
    in between."""
    matches = settle(explicit_matches(questions, answers))
    matches = settle(matches.unionByName(fuzzy_matches(questions, answers, matches)))
    return settle(matches.unionByName(structural_matches(questions, answers, matches)))


# ---- likeness of content -------------------------------------------------------------------------------------------


TEXTS_A_TASK = 20_000


def _tokens(docs: DataFrame) -> Column:
    """The tokens of a text: its column ``tokens``, where the caller has read them before, else of ``text``."""
    return F.col("tokens") if "tokens" in docs.columns else tokenize(F.col("text"))


def _dealt_by_key(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Texts dealt by key over as many tasks as keep each at some ``TEXTS_A_TASK`` of them, whatever the session's number."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(least, -(-docs.count() // TEXTS_A_TASK)), *keys)


def lexical_index(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, df, idf) over the texts of each key: idf = ln((N + 1) / (df + 1)) + 1. Texts are dealt by key first, so a
    task counts the tokens of a bounded number of texts, and the counts are dealt no more."""
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
    dealt = _dealt_by_key(docs.select(*keys, *(c for c in ("text", "tokens") if c in docs.columns)), keys)
    df = dealt.select(*keys, F.explode(F.array_distinct(_tokens(docs))).alias("token"))
    counted = df.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(n, keys).select(*keys, "token", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


class _Weighed:
    """The term weights of one key's texts as arrays: for every kept (text, token) the text's number, the token's and the weight.
    Rows of equal ``ids`` are one text; their shares of tokens are told by the length of each."""

    def __init__(self, texts: pa.Table, ids: list[str]):
        listed = pc.split_pattern(texts.column("_t").combine_chunks(), " ")
        length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
        words = listed.flatten().dictionary_encode()
        self.words, n = words.dictionary, max(1, len(words.dictionary))
        text = np.zeros(len(length), np.int64)
        for c in ids:
            own = texts.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            text = np.unique(text * (len(own.dictionary) + 1) + own.indices.to_numpy(), return_inverse=True)[1]
        self.row = np.zeros(text.max() + 1, np.int64)  # a row of each text, which holds its ids
        self.row[text] = np.arange(len(text))
        sizes, size = np.unique(length, return_inverse=True)
        cells, count = np.unique(np.repeat(text * len(sizes) + size, length) * n + words.indices.to_numpy(), return_counts=True)
        part, self.word = np.divmod(cells, n)
        self.text, size = np.divmod(part, len(sizes))
        df = np.bincount(np.unique(self.text * n + self.word) % n, minlength=n)
        self.weight = count / sizes[size] * (np.log((len(length) + 1) / (df + 1)) + 1)[self.word]


def _by_key(docs: DataFrame, keys: list[str], ids: list[str], function, schema: StructType) -> DataFrame:
    """``function`` (a table of keys, ids and ``_t``, a text's tokens joined by spaces) over the texts of each key. A text is tokenised
    once and dealt once, whole: its tokens are never rows of a shuffle. Rows without a key meet none."""
    texts = docs.select(*keys, *ids, F.nullif(F.array_join(_tokens(docs), " "), F.lit("")).alias("_t")).dropna(subset=keys)
    return texts.groupBy(*keys).applyInArrow(function, schema)


def _fields(docs: DataFrame, names: list[str]) -> list[StructField]:
    return [StructField(c, docs.schema[c].dataType) for c in names]


def term_weights(docs: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """(keys, ids, token, weight): share of the text's kept tokens times idf = ln((N + 1) / (df + 1)) + 1 over the N texts of the key, of
    which df hold the token. The texts of a key meet in one task, whose arrays its pages bound."""

    def weigh(texts: pa.Table) -> pa.Table:
        w = _Weighed(texts, ids)
        of = texts.select([*keys, *ids]).take(pa.array(w.row[w.text]))
        return pa.table([*of.columns, w.words.take(pa.array(w.word)), pa.array(w.weight)], [*keys, *ids, "token", "weight"])

    return _by_key(docs, keys, ids, weigh, StructType([*_fields(docs, [*keys, *ids]), StructField("token", StringType()), StructField("weight", DoubleType())]))


CELLS = 1 << 21  # of a block of weights by text and token, at most


def _products(w: _Weighed, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(answers, questions, sums of products of weights) of texts with common tokens, block by block of both sides' texts."""
    answer, question = (sides[w.text] == s for s in "aq")
    n = len(w.words)
    common = (np.bincount(w.word[answer], minlength=n) > 0) & (np.bincount(w.word[question], minlength=n) > 0)
    place = np.cumsum(common) - 1
    width = int(common.sum())
    if not width:
        return

    def blocks(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kept = side & common[w.word]
        texts, row = np.unique(w.text[kept], return_inverse=True)
        word, weight, step = place[w.word[kept]], w.weight[kept], max(1, CELLS // width)
        for first in range(0, len(texts), step):
            rows = min(step, len(texts) - first)
            inside = (row >= first) & (row < first + rows)
            cells = np.bincount((row[inside] - first) * width + word[inside], weight[inside], rows * width)
            yield texts[first : first + rows], cells.reshape(rows, width)

    for asked, q in blocks(question):
        for told, a in blocks(answer):
            sums = a @ q.T
            i, j = np.nonzero(sums)  # weights are above 0, so are the sums of those with a common token
            yield told[i], asked[j], sums[i, j]


def lexical_scores(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, scores): for every answer (side a) the questions (side q) with common tokens, as an array of (q, score): cosine of the
    term weights, to nine places, so that the order of summation cannot decide a tie. The texts of a key meet in one task as
    matrices; neither tokens nor pairs are dealt."""
    ix = docs.schema["ix"].dataType

    def score(texts: pa.Table) -> pa.Table:
        w = _Weighed(texts, ["side", "ix"])
        norm = np.sqrt(np.bincount(w.text, w.weight * w.weight, len(w.row)))
        sides = np.array(texts.column("side").to_pylist(), object)[w.row]
        found = list(_products(w, sides))
        a, q, sums = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((q, a))
        a, q, sums = a[order], q[order], sums[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        own = texts.column("ix").combine_chunks()
        pairs = pa.StructArray.from_arrays([own.take(pa.array(w.row[q])), pc.round(pa.array(sums / (norm[a] * norm[q])), 9)], ["q", "score"])
        scores = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pairs)
        of = texts.select(keys).take(pa.array(w.row[a[first]]))
        return pa.table([*of.columns, own.take(pa.array(w.row[a[first]])), scores], [*keys, "a", "scores"])

    pair = StructType([StructField("q", ix), StructField("score", DoubleType())])
    return _by_key(docs, keys, ["side", "ix"], score, StructType([*_fields(docs, keys), StructField("a", ix), StructField("scores", ArrayType(pair))]))


def lexical_pairs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, q, score): the pairs of ``lexical_scores`` as rows."""
    return lexical_scores(docs, keys).select(*keys, "a", F.inline("scores"))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))
    norm = lambda z: F.sqrt(total(F.transform(z, lambda v: v.cast("double") * v.cast("double"))))
    both = norm(x) * norm(y)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot / both)


def embedding_pairs(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, q, score): cosine of answer and question vectors within a key, not below 0, to nine places. Each question
    meets each answer of its own sheet, whose sizes a sheet's pages bound; a sheet's questions travel as one array."""
    a = vectors.where("side = 'a'").select(*keys, F.col("ix").alias("a"), F.col("embedding").alias("va"))
    q = vectors.where("side = 'q'").groupBy(*keys).agg(F.collect_list(F.struct(F.col("ix").alias("q"), F.col("embedding").alias("vq"))).alias("qs"))
    met = a.join(q, keys).select(*keys, "a", "va", F.inline("qs"))
    return met.select(*keys, "a", "q", F.round(F.greatest(F.lit(0.0), cosine(F.col("va"), F.col("vq"))), 9).alias("score"))


def similarity_pairs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, q, score, signal): pairs by vector (``embedding``) where every text of the key has one, else by words,
    with ``signal`` unusable_response for lexical pairs that stand in for missing vectors."""
    whole = texts.groupBy(*keys).agg(F.bool_and(F.col("embedding").isNotNull()).alias("_whole"))
    marked = settle(texts.join(whole, keys))
    by_vector = embedding_pairs(marked.where("_whole"), keys).withColumn("signal", F.lit("embedding"))
    return by_vector.unionByName(lexical_pairs(marked.where("NOT _whole"), keys).withColumn("signal", F.lit("unusable_response")))


def best_and_runner_up(pairs: DataFrame, keys: list[str], accept: float = ACCEPT) -> DataFrame:
    """(keys, a, q, score, margin): each answer's best question if it reaches ``accept``; ties to the lower question."""
    order = Window.partitionBy(*keys, "a").orderBy(F.desc("score"), "q")
    ranked = pairs.select("*", F.row_number().over(order).alias("_rn"), (F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).alias("margin"))
    return ranked.where(F.col("_rn") == 1).where(F.col("score") >= accept).drop("_rn")


def best_of_scores(scores: DataFrame, keys: list[str], accept: float = ACCEPT) -> DataFrame:
    """``best_and_runner_up`` of ``lexical_scores``: each answer's scores lie in its row, so nothing is dealt or sorted but they."""
    ranked = scores.select(*keys, "a", F.sort_array(F.transform("scores", lambda x: F.struct((-x["score"]).alias("s"), x["q"].alias("q")))).alias("_r"))
    second = F.coalesce(F.get("_r", F.lit(1))["s"], F.lit(0.0))
    best = ranked.select(*keys, "a", F.get("_r", F.lit(0))["q"].alias("q"), (-F.get("_r", F.lit(0))["s"]).alias("score"), second.alias("_s"))
    return best.where(F.col("score") >= accept).select(*keys, "a", "q", "score", (F.col("score") + F.col("_s")).alias("margin"))


def greedy_best_first(best: DataFrame, keys: list[str]) -> DataFrame:
    """A question goes to the answer that scores it best; losers get no second choice."""
    order = Window.partitionBy(*keys, "q").orderBy(F.desc("score"), "a")
    return best.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def semantic_confidence(score: Column, margin: Column) -> Column:
    base = F.least(F.lit(0.7), 0.42 + score * 0.4)
    return F.when(margin >= MARGIN, base).otherwise(base * 0.85)


def semantic_matches(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Open answers and open questions of a sheet by likeness of their texts."""
    side = lambda df, ix, name: df.select(*SHEET, F.lit(name).alias("side"), F.col(ix).alias("ix"), "text")
    docs = side(open_answers(questions, answers, matches), "a_ord", "a").unionByName(
        side(open_questions(questions, answers, matches), "q_ord", "q")
    )
    won = greedy_best_first(best_of_scores(lexical_scores(docs, SHEET), SHEET), SHEET)
    close = F.when(F.col("margin") >= MARGIN, "").otherwise(SAID["close"])
    return won.select(
        *SHEET,
        F.col("q").alias("q_ord"),
        F.col("a").alias("a_ord"),
        semantic_confidence(F.col("score"), F.col("margin")).alias("confidence"),
        F.lit("semantic_match").alias("method"),
        F.concat(F.format_string(SAID["semantic_match"], "score"), close, F.lit(".")).alias("reason"),
    )


def resolve_suggestions(suggestions: DataFrame, open_q: DataFrame, open_a: DataFrame) -> DataFrame:
    """(sheet, state) with state (questions, answers, taken): suggested pairs (sheet, seq, q_ord, a_ord, confidence, reason) of
    an open question and an open answer in turn; the first row wins on either side."""
    open_ = suggestions.join(open_q.select(*SHEET, "q_ord"), [*SHEET, "q_ord"], "left_semi").join(open_a.select(*SHEET, "a_ord"), [*SHEET, "a_ord"], "left_semi")
    steps = open_.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("seq", "q_ord", "a_ord", "confidence", "reason"))).alias("steps"))
    none = F.array().cast("array<bigint>")
    rows = F.array().cast("array<struct<seq:bigint,q_ord:bigint,a_ord:bigint,confidence:double,reason:string>>")
    zero = F.struct(none.alias("questions"), none.alias("answers"), rows.alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used = F.array_contains(acc["questions"], x["q_ord"]) | F.array_contains(acc["answers"], x["a_ord"])
        took = F.struct(
            F.array_append(acc["questions"], x["q_ord"]).alias("questions"), F.array_append(acc["answers"], x["a_ord"]).alias("answers"),
            F.array_append(acc["taken"], x).alias("taken"),
        )
        return F.when(used, acc).otherwise(took)

    return steps.select(*SHEET, F.aggregate("steps", zero, step).alias("state"))


def apply_suggestions(suggestions: DataFrame, questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of the suggestions that ``resolve_suggestions`` takes."""
    state = resolve_suggestions(suggestions, open_questions(questions, answers, matches), open_answers(questions, answers, matches))
    return state.select(*SHEET, F.inline("state.taken")).select(
        *SHEET, "q_ord", "a_ord", F.least(F.lit(SUGGESTED_MOST), F.coalesce("confidence", F.lit(0.5))).alias("confidence"),
        F.lit("llm_reasoning").alias("method"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit(SAID["llm_reasoning"])).alias("reason"),
    )


def corroborate(matches: DataFrame) -> DataFrame:
    """(sheet, q_ord, a_ord, confidence, methods, reasons): one row per question. The earliest step's answer stands; later
    steps that name the same answer raise its confidence by 0.15 of the weaker, to 0.99 at most, and add method and reason;
    those that name another are left out."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STEPS)), F.col("method"))
    steps = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "a_ord", "confidence", "method", "reason")))
    per_question = matches.groupBy(*SHEET, "q_ord").agg(steps.alias("_all"))
    per_question = per_question.withColumn("a_ord", F.col("_all")[0]["a_ord"]).withColumn("_same", F.filter("_all", lambda x: x["a_ord"] == F.col("a_ord")))
    raised = lambda c, x: F.when(c.isNull(), x["confidence"]).otherwise(F.least(F.lit(0.99), F.greatest(c, x["confidence"]) + F.least(c, x["confidence"]) * 0.15))
    return per_question.select(
        *SHEET, "q_ord", "a_ord", F.aggregate("_same", F.lit(None).cast("double"), raised).alias("confidence"),
        F.array_distinct(F.transform("_same", lambda x: x["method"])).alias("methods"), F.transform("_same", lambda x: x["reason"]).alias("reasons"),
    )


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence <= 0, "none").when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")
    )


def cap_by_legibility(confidence: Column, reading: Column) -> Column:
    return F.when(reading < LEGIBLE, F.least(confidence, F.lit(0.6))).otherwise(confidence)


def append_reasons(methods: Column, reasons: Column, reading: Column, pages: Column) -> Column:
    """Struct (methods, reasons) of a match with what its answer adds: ``continuation`` for several regions, and notes on hard
    handwriting and on several pages, which are named in order."""
    distinct = F.array_sort(F.array_distinct(pages))
    notes = F.array_compact(
        F.array(
            F.when(reading < LEGIBLE, SAID["hard"]),
            F.when(F.size(distinct) > 1, F.format_string(SAID["pages"], F.array_join(distinct.cast("array<string>"), " and "))),
        )
    )
    more = F.when(F.size(pages) > 1, F.array(F.lit("continuation"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.array_union(methods, more).alias("methods"), F.concat(reasons, notes).alias("reasons"))


def finalize_mappings(questions: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per question of every sheet: paper_id, student_ix, q_ord, a_ord, confidence, band, status, methods, reasons."""
    sheets = answers.select(*SHEET).distinct()
    read = answers.select(*SHEET, "a_ord", F.col("confidence").alias("reading"), "pages")
    rows = (
        sheets.join(questions.select("paper_id", "q_ord"), "paper_id")
        .join(corroborate(matches), [*SHEET, "q_ord"], "left").join(read, [*SHEET, "a_ord"], "left")
    )
    found = F.col("a_ord").isNotNull()
    c = F.coalesce(cap_by_legibility(F.col("confidence"), F.coalesce("reading", F.lit(1.0))), F.lit(0.0))
    none = F.struct(F.array().cast("array<string>").alias("methods"), F.array(F.lit(SAID["none"])).alias("reasons"))
    said = F.when(found, append_reasons(F.col("methods"), F.col("reasons"), F.col("reading"), F.col("pages"))).otherwise(none)
    status = F.when(~found, "unanswered").when(c < REVIEW, "needs_review").otherwise("matched")
    return rows.select(
        *SHEET, "q_ord", "a_ord", F.round(c, 3).alias("confidence"), confidence_band(c).alias("band"), status.alias("status"), said.alias("_s")
    ).select(*SHEET, "q_ord", "a_ord", "confidence", "band", "status", "_s.methods", "_s.reasons")


def map_answers(questions: DataFrame, answers: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """All steps in turn, then one row per question."""
    matches = deterministic_matches(questions, answers)
    matches = settle(matches.unionByName(semantic_matches(questions, answers, matches)))
    if suggestions is not None:
        matches = matches.unionByName(apply_suggestions(suggestions, questions, answers, matches))
    return finalize_mappings(questions, answers, matches)


def unmatched_answers(answers: DataFrame, mappings: DataFrame) -> DataFrame:
    return answers.join(mappings.where("a_ord IS NOT NULL"), [*SHEET, "a_ord"], "left_anti")


def result_summary(mappings: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Per sheet: total, answered (status matched only), unanswered, needs_review, unmatched_answers."""
    counts = mappings.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "matched").alias("answered"),
        F.count_if(F.col("status") == "unanswered").alias("unanswered"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
    )
    left = unmatched.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("unmatched_answers"))
    return counts.join(left, SHEET, "left").withColumn("unmatched_answers", F.coalesce("unmatched_answers", F.lit(0)))
