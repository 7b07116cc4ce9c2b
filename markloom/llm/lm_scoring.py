"""LM scoring by a gated recurrent language model with a class-factored output.

What is learnt from the corpus, over all training documents: the count of every token, found with one shuffle of
partial counts and kept as a table. The recurrent model works on the ``head_words`` most frequent tokens, on
classes of all other tokens by their shape, and on the end of a text. It is trained with truncated backpropagation
in numpy, data-parallel, on all training documents: each round's part of them is dealt into lots by a hash of its
rows; every lot starts from the common weights, and the weights are averaged between rounds. So the result does not depend on how the table is cut into partitions. A token's
probability is its class's, times its word's within the class (a softmax for the head, (count + 1) / (tokens +
types + 1) of the class for the tail), so unseen tokens have a probability too.

A document is scored whole: windows of a fixed number of steps, with the state carried from one to the next."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import arrow_pass, materialize

HEAD_WORDS = 1024  # tokens with a word of their own in the model
KNOWN_WORDS = 200_000  # bound of the tokens whose counts are sent to every task; counts of rarer ones are joined
CLASS_SIZE = 32
HIDDEN = 32
SHARE = 1.0  # of the training documents, for the recurrent weights: all of them
ROUNDS = 2
LOT_TOKENS = 2_000_000  # of a lot, about
WINDOW = 32
AHEAD = 8192  # numbers that scoring takes at a time, about
TOGETHER = 4_000_000  # numbers of texts that wait to be scored side by side: a long text's steps cost the same alone
STREAMS, MOST_STREAMS = 64, 256  # that learn side by side: a step over more of them costs less a token, but a small lot needs its steps
FLUSH = 400_000  # distinct tokens that a counting task holds before it passes them on

SHAPES = 18


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts with A-Z lower-cased, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # cuts at just these; an edge of white space leaves an empty word
    words = lists.flatten()
    of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    real = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(real)).cast(pa.binary()), np.bincount(of[real], minlength=len(texts))


def shape(word: bytes) -> int:
    """Class of a tail token: how it ends (3), whether it has other than ASCII characters (2), its length (3)."""
    last = word[-1]
    end = 0 if last >= 128 or 48 <= last <= 57 or 97 <= last <= 122 else 1 if last in b".,;:?" else 2
    return (end * 2 + (not word.isascii())) * 3 + (0 if len(word) <= 4 else 1 if len(word) <= 8 else 2)


def shapes(words: pa.Array) -> np.ndarray:
    """``shape`` of each of the words (binary, none of them empty)."""
    size = pc.binary_length(words).to_numpy()
    last = np.frombuffer(pc.binary_slice(words, -1).buffers()[2] or b"", np.uint8, len(words))
    plain = ~((last >= 128) | ((48 <= last) & (last <= 57)) | ((97 <= last) & (last <= 122)))
    end = np.where(plain, np.where(np.isin(last, list(b".,;:?")), 1, 2), 0)
    ascii_ = np.asarray(pc.string_is_ascii(words.cast(pa.string(), safe=False)).to_numpy(zero_copy_only=False), bool)
    return ((end * 2 + ~ascii_) * 3 + np.where(size <= 4, 0, np.where(size <= 8, 1, 2))).astype(np.int32)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, shape, c): the count of every token of ``docs``. Tasks count their own tokens first and pass
    partial counts on whenever they hold FLUSH distinct ones."""

    def emit(held: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in held.combine_chunks().to_batches():
            words = part.column("token")
            yield pa.RecordBatch.from_arrays([words.cast(pa.string(), safe=False), pa.array(shapes(words)), part.column("c")], ["token", "shape", "c"])

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns(["token", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            own = tokens(batch.column(0))[0].value_counts()
            waiting.append(pa.table({"token": own.field("values"), "c": own.field("counts")}))
            if sum(map(len, waiting)) > FLUSH:
                waiting = [merged(waiting)]
                if len(waiting[0]) > FLUSH:
                    yield from emit(waiting[0])
                    waiting = []
        if waiting:
            yield from emit(merged(waiting))

    partial = arrow_pass(docs.select("text"), count, "token string, shape int, c long")
    return partial.groupBy("token").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Tokens with known counts, the most frequent first, and the totals of the training tokens.

    Model numbers: 0..n_head-1 head words, then the shapes of the tail, then the end of a text."""

    words: list[bytes]
    counts: np.ndarray
    n_head: int
    n_tokens: int
    n_types: int
    n_texts: int
    shape_tokens: np.ndarray  # of the tail, by shape
    shape_types: np.ndarray

    @property
    def end(self) -> int:
        return self.n_head + SHAPES

    def tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The known words, and by their places: the model number, and log10(count + 1)."""
        words = pa.array(self.words, pa.binary())
        number = np.arange(len(words), dtype=np.int32)
        number[self.n_head :] = self.n_head + shapes(words[self.n_head :])
        return words, number, np.log10(self.counts + 1.0)


def vocabulary(counts: DataFrame, n_texts: int, head_words: int = HEAD_WORDS, known_words: int = KNOWN_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of its known words. Words are taken by whole levels of counts (eighths of
    a power of two), as many levels as hold at most ``known_words``; so the driver gets no more than that."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, least_level = 0, math.inf
    for at, n in reversed(levels):
        if total + n > known_words:
            break
        total, least_level = total + n, at
    rows = counts.where(level >= least_level).select("token", "c").collect() if total else []
    known = sorted(((r["token"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    n_head = min(head_words, len(known)) // CLASS_SIZE * CLASS_SIZE
    shapes = {r["shape"]: r for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    shape_tokens = np.array([shapes[i]["c"] if i in shapes else 0 for i in range(SHAPES)], np.int64)
    shape_types = np.array([shapes[i]["n"] if i in shapes else 0 for i in range(SHAPES)], np.int64)
    n_tokens, n_types = int(shape_tokens.sum()) + n_texts, int(shape_types.sum()) + (n_texts > 0)
    for w, c in known[:n_head]:
        shape_tokens[shape(w)] -= c
        shape_types[shape(w)] -= 1
    least = min((c for _, c in known), default=0)
    return Vocabulary([w for w, _ in known], np.array([c for _, c in known], np.int64), n_head, n_tokens, n_types, n_texts, shape_tokens, shape_types), least


def _exp_columns(logits: np.ndarray, bounded: bool) -> np.ndarray | float:
    """Exponentials in place; the shift of each column. Bounded logits need no shift."""
    top = 0.0 if bounded else logits.max(0)
    if not bounded:
        logits -= top
    np.exp(logits, out=logits)
    return top


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """Stable order of whole numbers in 0..below-1: short ones are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def _sums(rows: np.ndarray, below: int, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers 0..below-1 that occur in ``rows``, and the sums of their rows of ``values``, side by side. The values
    have one row more, of zeros: each number's rows are filled up to eights with it, so that most is added evenly."""
    order = _order(rows, below)
    own = rows[order]
    first = np.nonzero(np.diff(own, prepend=-1))[0]
    n = np.diff(first, append=len(own))
    eights = -(-n // 8)
    start = np.cumsum(eights) - eights
    at = np.full(8 * int(eights.sum()), len(own))
    at[np.arange(len(own)) + np.repeat(8 * start - first, n)] = order
    part = np.concatenate([np.take(v, at, axis=0).reshape(-1, 8, v.shape[1]).sum(1) for v in values], axis=1)
    return own[first], np.add.reduceat(part, start, axis=0)


@dataclass
class GatedLm:
    """A gated recurrent unit whose input weights are rows per token, and the class-factored softmax."""

    n_head: int
    w: dict[str, np.ndarray]

    @property
    def n_head_classes(self) -> int:
        return self.n_head // CLASS_SIZE

    @classmethod
    def start(cls, v: Vocabulary, hidden: int = HIDDEN, seed: int = 7) -> GatedLm:
        """Small random weights; the biases give every class and head word its relative frequency."""
        rng = np.random.default_rng(seed)
        n_classes = v.n_head // CLASS_SIZE + SHAPES + 1
        head = v.counts[: v.n_head].astype(np.float64)
        by_class = np.concatenate([head.reshape(-1, CLASS_SIZE).sum(1), v.shape_tokens, [v.n_texts]]) + 1
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(
            v.n_head,
            {
                "x": small(v.n_head + SHAPES + 1, 3 * hidden), "zr": small(hidden, 2 * hidden) * 2, "n": small(hidden, hidden) * 2,
                "c": small(hidden, n_classes), "cb": np.log(by_class / by_class.sum()).astype(np.float32),
                "o": small(v.n_head, hidden), "ob": np.log((head + 1) / (v.n_tokens + 1)).astype(np.float32),
            },
        )

    def _steps(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Weights of the steps, each gate's by itself (input rows of three gates; two gates; the last), with the signs
        and factors of the exponents put into them."""
        w, size = self.w, len(self.w["n"])
        rows = [np.ascontiguousarray(w["x"][:, i * size : (i + 1) * size]) * np.float32(f) for i, f in enumerate((-1, -1, -2))]
        return rows, -np.stack([w["zr"][:, :size], w["zr"][:, size:]]), w["n"] * np.float32(-2)

    def window(self, ids: np.ndarray, h: np.ndarray, keep: bool = False, lives: list[int] | None = None, weights=None):
        """States after each step of ``ids`` (steps, streams), from the state ``h``; with ``keep`` also the gates of each
        step and what the second let through. ``lives``: how many streams, the first ones, still go on at each step."""
        (xz, xr, xn), zr_w, n_w = weights or self._steps()
        size, kind = h.shape[1], xn.dtype
        zr, n = np.empty((2, *ids.shape, size), kind), np.empty((*ids.shape, size), kind)
        for table, gate in ((xz, zr[0]), (xr, zr[1]), (xn, n)):
            np.take(table, ids, axis=0, out=gate, mode="clip")
        out = np.empty((*ids.shape, size), np.float32)
        let = np.empty((len(ids) if keep else 1, *h.shape), kind)
        more_zr, more_n = np.empty((2, *h.shape), kind), np.empty(h.shape, kind)
        with np.errstate(over="ignore"):
            for t in range(len(ids)):
                k = lives[t] if lives else len(h)
                h = h[:k]
                gate, m, rh = zr[:, t, :k], n[t, :k], let[t if keep else 0, :k]
                gate += np.matmul(h, zr_w, out=more_zr[:, :k])
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[1], h, out=rh)
                m += np.matmul(rh, n_w, out=more_n[:k])
                np.exp(m, out=m)
                m += 1
                np.divide(2, m, out=m)
                m -= 1
                new = np.subtract(m, h, out=out[t, :k])
                new *= gate[0]
                new += h
                h = new
        return (out, h, (zr, n, let)) if keep else (out, h)

    def bounded(self) -> bool:
        """Whether no logit can leave [-80, 80]: states lie between -1 and 1."""
        w = self.w
        tops = [(np.abs(w["c"]).sum(0) + np.abs(w["cb"])).max(), (np.abs(w["o"]).sum(1) + np.abs(w["ob"])).max(initial=0)]
        return max(tops) < 80

    def class_of(self, target: np.ndarray) -> np.ndarray:
        return np.where(target < self.n_head, target // CLASS_SIZE, target - self.n_head + self.n_head_classes)

    def _outputs(self, h: np.ndarray, target: np.ndarray, bounded: bool):
        """Rows in the order of their targets' classes, head words first: (order, states, classes, exponentials of all
        classes, each one's own logit less its shift; then for the head words their place in the class, the exponentials
        of its words, own logits likewise; and (class, first row, row after the last) of the head)."""
        w = self.w
        cls = self.class_of(target)
        order = _order(cls, len(w["cb"]))
        h, cls, target = np.take(h, order, axis=0), cls[order], target[order]
        each = np.arange(len(h))
        p = w["c"].T @ h.T
        p += w["cb"][:, None]
        own = p[cls, each]
        own -= _exp_columns(p, bounded)
        cuts = np.searchsorted(cls, np.arange(self.n_head_classes + 1)).tolist()
        parts = [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        place = target[: cuts[-1]] % CLASS_SIZE
        q = np.empty((CLASS_SIZE, len(place)), p.dtype)
        for c, a, b in parts:
            s = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            np.matmul(w["o"][s], h[a:b].T, out=q[:, a:b])
            q[:, a:b] += w["ob"][s, None]
        own_q = q[place, each[: len(place)]]
        own_q -= _exp_columns(q, bounded)
        return order, h, cls, p, own, place, q, own_q, parts

    def log_probs(self, h: np.ndarray, target: np.ndarray, bounded: bool | None = None) -> np.ndarray:
        """Natural log probability of each target: of its class, and of its word for head words."""
        order, _, _, p, own, _, q, own_q, _ = self._outputs(h, target, self.bounded() if bounded is None else bounded)
        own -= np.log(p.sum(0))
        own_q -= np.log(q.sum(0))
        own[: len(own_q)] += own_q
        out = np.empty_like(own)
        out[order] = own
        return out

    def gradients(self, ids: np.ndarray, target: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss over a window, back to its first step, and the state after it."""
        w, size = self.w, h0.shape[1]
        out, last, (zr, n, let) = self.window(ids, h0, keep=True)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        order, flat, cls, p, _, place, q, _, parts = self._outputs(out.reshape(-1, size), target.ravel(), self.bounded())
        each, part = np.arange(len(flat)), np.float32(1 / len(flat))
        p *= part / p.sum(0)
        p[cls, each] -= part
        g["c"], g["cb"] = (p @ flat).T, p.sum(1)
        back = p.T @ w["c"].T
        q *= part / q.sum(0)
        q[place, each[: len(place)]] -= part
        for c, a, b in parts:
            s = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            g["o"][s], g["ob"][s] = q[:, a:b] @ flat[a:b], q[:, a:b].sum(1)
            back[a:b] += q[:, a:b].T @ w["o"][s]
        place_of = np.empty_like(order)
        place_of[order] = each
        dout = np.take(back, place_of, axis=0).reshape(out.shape)
        before = np.concatenate([h0[None], out[:-1]])
        back_n = np.ascontiguousarray(w["n"].T)
        back_zr = np.stack([w["zr"][:, :size].T, w["zr"][:, size:].T])
        flats = [np.zeros((ids.size + 1, size), n.dtype) for _ in range(3)]
        dz_all, dr_all, dn = (f[:-1].reshape(out.shape) for f in flats)
        carry = np.zeros_like(dout[0])
        more, through, left = np.empty_like(dn[0]), np.empty_like(dn[0]), np.empty_like(zr[:, 0])
        for t in range(len(ids) - 1, -1, -1):
            z, r, m, h, d = zr[0, t], zr[1, t], n[t], before[t], dout[t]
            dz, dr, da = dz_all[t], dr_all[t], dn[t]
            d += carry
            np.subtract(1, zr[:, t], out=left)
            np.multiply(d, z, out=through)
            np.subtract(d, through, out=carry)
            np.subtract(m, h, out=dz)
            dz *= left[0]
            dz *= through
            np.multiply(m, m, out=da)
            np.subtract(1, da, out=da)
            da *= through
            drh = np.matmul(da, back_n, out=through)
            drh *= r
            carry += drh
            np.multiply(drh, h, out=dr)
            dr *= left[1]
            carry += np.matmul(dz, back_zr[0], out=more)
            carry += np.matmul(dr, back_zr[1], out=more)
        states = before.reshape(-1, size)
        g["n"] = let.reshape(-1, size).T @ flats[2][:-1]
        g["zr"] = np.concatenate([states.T @ flats[0][:-1], states.T @ flats[1][:-1]], axis=1)
        seen, sums = _sums(ids.ravel(), len(w["x"]), flats)
        g["x"][seen] = sums
        return g, last

    def log10_scores(self, docs: list[np.ndarray], together: int = 512) -> np.ndarray:
        """log10 probability of each document's model numbers (which end with the end): documents of like lengths
        run side by side, window after window, and leave when they are over."""
        total = np.zeros(len(docs))
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([[self.n_head + SHAPES], *docs]).astype(np.int64)  # before each text stands an end
        order = np.argsort(-lengths, kind="stable")
        weights, bounded = self._steps(), self.bounded()
        for group in np.split(order, range(together, len(order), together)):
            size, first = lengths[group], starts[group]
            h = np.zeros((len(group), len(self.w["n"])), np.float32)
            a, longest = 0, int(size.max(initial=0))
            while a < longest:
                live = int((size > a).sum())
                at = a + np.arange(min(longest - a, max(8, AHEAD // live)))[:, None]
                real = at < size[:live]
                at = np.minimum(at + first[:live], len(flat) - 2)
                states, h = self.window(flat[at], h[:live], lives=real.sum(1).tolist(), weights=weights)
                rows = np.flatnonzero(real)
                p = self.log_probs(np.take(states.reshape(-1, h.shape[1]), rows, axis=0), flat[at.ravel()[rows] + 1], bounded)
                total[group[:live]] += np.bincount(rows % live, weights=p, minlength=live)
                a += len(at)
        return total / math.log(10)


class Learner:
    """Adam over a run of model numbers that comes in pieces: as soon as enough have come they are cut into parallel
    streams and learnt window after window, the state carried over (truncated backpropagation). How the run is cut into
    pieces makes no difference. ``rate`` falls linearly, to ``decay`` times itself after ``expected`` numbers."""

    def __init__(self, model: GatedLm, rate: float, decay: float, expected: float):
        self.streams = min(MOST_STREAMS, max(STREAMS, int(expected / (WINDOW * 250))))  # some 250 steps, or as many streams as may be
        self.chunk = self.streams * WINDOW * 16
        self.model = GatedLm(model.n_head, {k: a.copy() for k, a in model.w.items()})
        self.rate, self.decay, self.expected = rate, decay, expected
        self.m1 = {k: np.zeros_like(v) for k, v in self.model.w.items()}
        self.m2 = {k: np.zeros_like(v) for k, v in self.model.w.items()}
        self.waiting = [np.array([model.n_head + SHAPES], np.int32)]  # an end stands before the first text
        self.size, self.seen, self.updates = 1, 0, 0

    def feed(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.size += len(numbers)
        if self.size > self.chunk:
            run = np.concatenate(self.waiting)
            at = 0
            while len(run) - at > self.chunk:
                self._learn(run[at : at + self.chunk + 1], self.streams)
                at += self.chunk
            self.waiting, self.size = [run[at:]], len(run) - at

    def finish(self) -> GatedLm:
        run = np.concatenate(self.waiting)
        if len(run) > 1:
            self._learn(run, max(1, min(self.streams, len(run) // (WINDOW + 1))))
        self.waiting, self.size = [run[-1:]], 1
        return self.model

    def _learn(self, run: np.ndarray, streams: int) -> None:
        steps = (len(run) - 1) // streams
        x = run[: steps * streams].reshape(streams, steps).T
        y = run[1 : steps * streams + 1].reshape(streams, steps).T
        w = self.model.w
        h = np.zeros((streams, w["n"].shape[0]), np.float32)
        for at in range(0, steps, WINDOW):
            g, h = self.model.gradients(x[at : at + WINDOW], y[at : at + WINDOW], h)
            self.seen += x[at : at + WINDOW].size
            self.updates += 1
            size = math.sqrt(sum(float(np.vdot(d, d)) for d in g.values()))
            clip = min(1.0, 1.0 / (size + 1e-9))
            past = min(1.0, self.seen / self.expected)
            now = self.rate * (1 - (1 - self.decay) * past) * math.sqrt(1 - 0.98**self.updates) / (1 - 0.9**self.updates)
            for k, all_d in g.items():
                flat = [a.reshape(-1) for a in (np.ascontiguousarray(all_d), self.m1[k], self.m2[k], w[k])]
                for a in range(0, len(flat[0]), 1 << 14):
                    d, m1, m2, own = (x[a : a + (1 << 14)] for x in flat)
                    d *= clip
                    m1 *= 0.9
                    m1 += 0.1 * d
                    d *= d
                    m2 *= 0.98
                    d *= 0.02
                    m2 += d
                    np.sqrt(m2, out=d)
                    d += 1e-6
                    np.divide(m1, d, out=d)
                    d *= now
                    own -= d


_BLOCK = 8192


def _pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.float64) for v in sorted(pdf["v"])], axis=0)  # in an order that arrival does not change
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lot": [pdf["lot"].iloc[0] // 256], "weight": [pdf["weight"].sum()], "v": [total.tobytes()]})


def train_round(docs: DataFrame, n_lots: int, model: GatedLm, v: Vocabulary, rate: float, decay: float, expected: float) -> GatedLm:
    """Every lot of ``docs`` (lot, place, text) learns from its own texts in the order of (place, text), starting from
    ``model``; the results are averaged by their numbers of tokens. A lot is read batch by batch, never gathered.
    Weights travel in blocks, summed in two steps of bounded groups."""
    sent = docs.sparkSession.sparkContext.broadcast((model, v))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, voc = sent.value
        known, number, _ = voc.tables()
        lot, learner, n = None, None, 0

        def done() -> pa.RecordBatch:
            flat = _pack(learner.finish().w).astype(np.float64) * n
            blocks = [flat[i : i + _BLOCK].tobytes() for i in range(0, len(flat), _BLOCK)]
            size = len(blocks)
            return pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([lot] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(blocks, pa.binary())],
                ["block", "lot", "weight", "v"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            lots = batch.column(0).to_numpy()
            words, per_text = tokens(batch.column(1))
            numbers = _numbers(words, per_text, known, number, voc)[0]
            ends = np.cumsum(per_text + 1)
            for own, part in zip(lots[np.diff(lots, prepend=lots[0] - 1) != 0], np.split(numbers, ends[:-1][np.diff(lots) != 0]), strict=True):
                if own != lot:
                    if learner is not None:
                        yield done()
                    lot, learner, n = int(own), Learner(start, rate, decay, expected), 0
                n += len(part)
                learner.feed(part)
        if learner is not None:
            yield done()

    schema = "block int, lot long, weight long, v binary"
    dealt = docs.repartition(n_lots, "lot").sortWithinPartitions("lot", "place", "text").select("lot", "text")
    sums = arrow_pass(dealt, learn, schema).withColumn("lot", F.floor(F.col("lot") / 256).cast("long"))
    for _ in range(2):
        sums = sums.groupBy("block", "lot").applyInPandas(_sum_blocks, schema)
    sums = sums.groupBy("block").applyInPandas(_sum_blocks, schema)
    rows = sorted(sums.collect(), key=lambda r: r["block"])
    if not rows:
        return model
    flat = np.concatenate([np.frombuffer(r["v"], np.float64) / r["weight"] for r in rows])
    return GatedLm(model.n_head, _unpack(flat.astype(np.float32), model.w))


def _numbers(words: pa.Array, per_text: np.ndarray, known: pa.Array, number: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Model numbers of the words of all texts, with an end after each text; and the place of each word, -1 where it is
    not known."""
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
    own = np.empty(len(at), np.int32)
    rare = at < 0
    own[~rare] = number[at[~rare]]
    own[rare] = v.n_head + shapes(words.filter(pa.array(rare)))
    out = np.full(len(at) + len(per_text), v.end, np.int32)
    out[np.arange(len(at)) + np.repeat(np.arange(len(per_text)), per_text)] = own
    return out, at


def score(docs: DataFrame, counts: DataFrame, least: int, model: GatedLm, v: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score for every row of ``docs`` (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, v))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, voc = sent.value
        known, number, logc = voc.tables()
        per_shape = np.log10(voc.shape_tokens + voc.shape_types + 1.0)
        end_log, end_known = math.log10(voc.n_texts + 1), int(voc.n_texts > 0)
        waiting, texts, held = [], [], 0

        def scored_batches() -> Iterator[pa.RecordBatch]:
            inner, at = lm.log10_scores(texts), 0
            for columns, tail in waiting:
                columns[5] = pa.array(inner[at : at + len(tail)] + tail, pa.float64())
                at += len(tail)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "logs", "inner", "rare"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, per_text = tokens(batch.column(2))
            numbers, at = _numbers(words, per_text, known, number, voc)
            of, size, ends = np.repeat(np.arange(len(per_text)), per_text), len(per_text), np.cumsum(per_text + 1)
            rare = at < 0
            logs = np.zeros(len(at))
            logs[~rare] = logc[at[~rare]]
            # what the class does not say of a tail word: its share of the class
            tail = rare | (at >= voc.n_head)
            shares = logs[tail] - per_shape[np.delete(numbers, ends - 1)[tail] - voc.n_head]
            offsets = np.append(0, np.cumsum(np.bincount(of[rare], minlength=size))).astype(np.int32)
            columns = [
                batch.column(0), batch.column(1), pa.array(per_text + 1, pa.int64()),
                pa.array(np.bincount(of[~rare], minlength=size) + end_known, pa.int64()),
                pa.array(np.bincount(of, weights=logs, minlength=size) + end_log, pa.float64()), None,
                pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(rare)).cast(pa.string(), safe=False)),
            ]
            waiting.append((columns, np.bincount(of[tail], weights=shares, minlength=size)))
            texts += np.split(numbers, ends[:-1])
            held += len(numbers)
            if held > TOGETHER:
                yield from scored_batches()
                waiting, texts, held = [], [], 0
        if waiting:
            yield from scored_batches()

    scored = materialize(
        arrow_pass(
            docs.select("doc_id", "held_out", "text"),
            apply,
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, inner double, rare array<string>",
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    # counts of the rarer words: a word that was never seen adds log10(0 + 1) = 0, so an inner join is enough
    rare = scored.select("_row", F.explode("rare").alias("token")).groupBy("_row", "token").agg(F.count(F.lit(1)).alias("n"))
    joined = rare.join(counts.where(F.col("c") < least).select("token", "c"), "token")
    added = joined.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("n").alias("more_known")
    )
    whole = scored.drop("rare").join(added, "_row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(math.log10(v.n_tokens + v.n_types + 1))).alias("base_score"),
        (F.col("inner") + more).alias("score"),
    )


def score_corpus(docs: DataFrame, holdout: tuple[int, int] = (7, 2), share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) modulo ``holdout[0]`` is not ``holdout[1]``; a null doc_id counts
    as an empty text there. Token counts cover all of them, and the recurrent weights are learnt on all of them (or on the
    ``share`` of them with the least hashes of id and text), in ``rounds`` disjoint parts. Null and empty texts have one token, the end.
    Repeated rows are scored, and counted in training, each. Texts are scored whole, whatever their length. Scores do
    not depend on the table's partitions (up to the last digits of 32-bit sums). Other columns are not used; an empty
    table gives no rows; without training documents every token is unseen and the model's weights stay as they start."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held = F.crc32(named) % holdout[0] == holdout[1]
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    counts = materialize(token_counts(training))
    v, least = vocabulary(counts, training.count())
    model = GatedLm.start(v)
    expected = v.n_tokens * share / rounds
    n_lots = max(1, round(expected / LOT_TOKENS))
    placed = training.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place"), F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(n_lots)).alias("lot"), "text"
    )
    for r in range(rounds):
        cut = [int((1 << 40) * share * (r + i) / rounds) for i in (0, 1)]
        sample = placed.where((F.col("place") >= cut[0]) & (F.col("place") < cut[1]))
        model = train_round(sample, n_lots, model, v, 0.01 * 0.5**r, 0.5 if r + 1 < rounds else 0.1, max(1.0, expected / n_lots))
    scored = score(docs, counts, least, model, v)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
