"""Every training document is learnt from, every text is scored whole, and batches are worked on as one."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markloom.llm import lm_scoring


def test_weights_are_learnt_on_every_training_document(spark, monkeypatch):
    rows = [(i, f"word{i % 40} of text {i} ends here.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = []
    whole = lm_scoring.train_round

    def counted(sample, *rest):
        learnt.extend(r.text for r in sample.select("text").collect())
        return whole(sample, *rest)

    monkeypatch.setattr(lm_scoring, "train_round", counted)
    held = {r.doc_id for r in lm_scoring.score_corpus(docs).where("held_out").collect()}
    assert sorted(learnt) == sorted(text for i, text in rows if i not in held)


def small_model():
    v = lm_scoring.Vocabulary([b"w%d" % i for i in range(32)], np.arange(32, 0, -1), 32, 700, 40, 5, np.full(18, 9), np.full(18, 3))
    return lm_scoring.GatedLm.start(v, hidden=8)


def test_words_and_shapes_of_a_batch_are_those_of_each_text():
    texts = [" A  b\x0b\x0cC. ", None, "", "\t\n ", "x\x1cY\x85z Q　R ß,", "Ünï (é) 日本語テキスト 12345 longwords; 😀", "a"]
    words, per_text = lm_scoring.tokens(pa.array(texts, pa.string()))
    each = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert words.to_pylist() == [w for own in each for w in own] and per_text.tolist() == [len(own) for own in each]
    assert lm_scoring.shapes(words).tolist() == [lm_scoring.shape(w) for w in words.to_pylist()]
    assert len(lm_scoring.shapes(words[:0])) == 0 and lm_scoring.shapes(words[2:5]).tolist() == lm_scoring.shapes(words).tolist()[2:5]


def test_sums_by_number():
    rng = np.random.default_rng(4)
    for n, below in ((1, 3), (9, 2), (500, 40), (3000, 70_000)):
        rows, values = rng.integers(0, below, n), rng.normal(size=(n + 1, 4))
        values[-1] = 0
        want = np.zeros((below, 8))
        np.add.at(want, rows, np.hstack([values[:-1], 2 * values[:-1]]))
        seen, sums = lm_scoring._sums(rows, below, [values, 2 * values])
        assert seen.tolist() == sorted(set(rows.tolist())) and np.allclose(sums, want[seen])


def test_a_long_text_is_scored_in_few_windows(monkeypatch):
    """Texts that run alone take many steps at a time, or the work around the steps costs more than they do."""
    m = small_model()
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(0, 50, n), 50).astype(np.int32) for n in (6000, 700, *rng.integers(0, 90, 600))]
    windows = []
    plain = lm_scoring.GatedLm.window

    def counted(self, ids, *rest, **named):
        windows.append(ids.size)
        return plain(self, ids, *rest, **named)

    monkeypatch.setattr(lm_scoring.GatedLm, "window", counted)
    got = m.log10_scores(texts)
    assert len(windows) < 30
    monkeypatch.undo()
    for i in (0, 1, 2, 300, 601):
        out, _ = m.window(np.append(50, texts[i][:-1])[:, None], np.zeros((1, 8), np.float32))
        assert math.isclose(got[i], m.log_probs(out[:, 0], texts[i]).sum() / math.log(10), rel_tol=1e-4)


def test_counts_of_words_beyond_the_known_ones_are_joined(spark):
    rows = [(i, " ".join(f"common{j}" for j in range(40)) + f" rare{i % 60} Alone{i}.") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    training = [t.lower().split() for i, t in rows if i % 5]
    c = Counter(w for t in training for w in t)
    counts = lm_scoring.token_counts(docs.where("not held_out")).cache()
    assert {r.token: r.c for r in counts.collect()} == c
    v, least = lm_scoring.vocabulary(counts, len(training), head_words=32, known_words=45)
    assert 32 < len(v.words) <= 45
    n, types = sum(c.values()) + len(training), len(c) + 1
    got = lm_scoring.score(docs, counts, least, lm_scoring.GatedLm.start(v), v).collect()
    assert len(got) == len(rows)
    for r in got:
        words = rows[r.doc_id][1].lower().split()
        base = sum(math.log10((c[w] + 1) / (n + types + 1)) for w in words) + math.log10((len(training) + 1) / (n + types + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_known == sum(c[w] > 0 for w in words) + 1
