"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns (assignments, access keys, long hex runs) always count. Besides them every run of key characters that is
long, or mixes letters with digits, is a candidate, less what a pattern has taken of it; the network sees the
characters of the candidate and of its surroundings, a long one through windows that slide over the whole of it, and
the greatest score counts. It is trained here, in numpy, on labelled findings made from rules with a fixed seed. Its
temperature and threshold are set on findings of other kinds than it was trained on: of the thresholds that keep the
stated recall of every kind there one that lets the fewest look-alikes pass is taken."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import arrow_pass

# Fixed values of the contract: the base patterns, their kinds in order, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("passw", "secret", "token", "api")

#: Candidates of the network: runs of key characters, LEAST_RUN at least, or LEAST_MIXED with letters and digits.
RUN = re.compile(r"[A-Za-z0-9+/_.~=-]{10,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
LEAST_RUN, LEAST_MIXED = 16, 10
WIDTH, BEFORE = 96, 32  # characters that the network sees, and how many of them stand before the candidate
STRIDE = 40  # of the windows over a long candidate
RECALL = 0.97  # of every kind of secret that calibrates
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n+/_.~=-\"':;,()[]{}<>@#$%&*!?|\\"
_CODE = {c: i + 2 for i, c in enumerate(_ALPHABET)}  # 0: outside the text, 1: any other character
_CODES = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping per kind, too short ones dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for run in RUN.finditer(text):  # a hex run of the least length always lies inside one
        if run.end() - run.start() >= LEAST["hex"]:
            out += [
                (m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST["hex"]
            ]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of key characters, without closing punctuation, less what the base spans cover of them."""
    found = []
    covered = []  # disjoint stretches of the base spans
    for a, b, _ in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    starts = [c[0] for c in covered]
    for m in RUN.finditer(text):
        start, end = m.start(), m.start() + len(m.group().rstrip(".="))
        free = [(start, end)]
        if covered:
            free = []
            at = start
            for a, b in covered[max(0, bisect_right(starts, start) - 1) : bisect_right(starts, end - 1)]:
                if b > at:
                    if a > at:
                        free.append((at, a))
                    at = b
            if at < end:
                free.append((at, end))
        found += [(a, b) for a, b in free if b - a >= LEAST_RUN or (b - a >= LEAST_MIXED and MIXED.match(text[a:b]))]
    return found


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Each (WIDTH, 2): code of a character, and whether it is in the candidate. The first begins BEFORE characters before
    the candidate; where that does not show the candidate and as many characters behind it, others follow at STRIDE."""
    first = start - BEFORE
    last = max(first, end + BEFORE - WIDTH)
    return [_window(text, at, start, end) for at in (*range(first, last, STRIDE), last)]


def _window(text: str, first: int, start: int, end: int) -> np.ndarray:
    out = np.zeros((WIDTH, 2), np.int64)
    a, b = max(first, 0), min(first + WIDTH, len(text))
    out[a - first : b - first, 0] = [_CODE.get(c, 1) for c in text[a:b]]
    out[max(start - first, 0) : max(end - first, 0), 1] = 1
    return out


@dataclass
class CharCnn:
    """Embedding, one convolution with ReLU, maxima inside and outside the candidate, and a logistic layer."""

    w: dict[str, np.ndarray]
    span: int = 5
    threshold: float = 0.5
    scale: float = 1.0

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        w, k = self.w, self.span
        e = w["emb"][x[..., 0]]
        inside = x[..., 1].astype(np.float32)
        e = np.concatenate([e, inside[..., None]], 2)
        n, length, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(n, length - k + 1, k * d)
        r = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
        mask = inside[:, k // 2 : length - k // 2, None]
        at_in, at_out = (r * mask).argmax(1), (r * (1 - mask)).argmax(1)
        mean = (r * mask).sum(1) / np.maximum(mask.sum(1), 1)
        pick = lambda at: np.take_along_axis(r, at[:, None, :], 1)[:, 0]
        top = np.concatenate([pick(at_in) * np.take_along_axis(mask, at_in[:, None, :], 1)[:, 0], pick(at_out) * (1 - np.take_along_axis(mask, at_out[:, None, :], 1)[:, 0]), mean], 1)
        logit = top @ w["out"] + w["out_b"][0]
        return {"cols": cols, "r": r, "mask": mask, "in": at_in, "outs": at_out, "top": top, "logit": logit}

    def logits(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The greatest logit over the windows of each finding (text, start, end)."""
        out = np.full(len(found), -np.inf)
        owner: list[int] = []
        shown: list[np.ndarray] = []
        for i, finding in enumerate(found):
            for w in windows(*finding):
                owner.append(i)
                shown.append(w)
            if len(shown) >= 256 or i + 1 == len(found):
                for at in range(0, len(shown), 256):
                    np.maximum.at(out, owner[at : at + 256], self.forward(np.stack(shown[at : at + 256]))["logit"])
                owner, shown = [], []
        return out

    def score(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities of the findings (text, start, end)."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(found), -30, 30)))


def _gradients(m: CharCnn, x: np.ndarray, f: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    w, c = m.w, m.w["conv"].shape[1]
    dtop = dlogit[:, None] * w["out"][None]
    dr = np.zeros_like(f["r"])
    n = np.arange(len(x))[:, None]
    ch = np.arange(c)[None]
    mask = f["mask"][..., 0]
    dr[n, f["in"], ch] += dtop[:, :c] * mask[n, f["in"]]
    dr[n, f["outs"], ch] += dtop[:, c : 2 * c] * (1 - mask[n, f["outs"]])
    dr += f["mask"] * (dtop[:, 2 * c :] / np.maximum(f["mask"].sum(1), 1))[:, None]
    dr *= f["r"] > 0
    size = f["cols"].shape[2]
    dcols = (dr @ w["conv"].T).reshape(*dr.shape[:2], m.span, size // m.span)
    codes = np.concatenate([x[:, j : j + dr.shape[1], 0].ravel() for j in range(m.span)])
    each = np.concatenate([dcols[:, :, j, :-1].reshape(-1, w["emb"].shape[1]) for j in range(m.span)])
    demb = np.stack([np.bincount(codes, v, _CODES) for v in each.T], 1).astype(np.float32)
    return {
        "emb": demb, "conv": f["cols"].reshape(-1, size).T @ dr.reshape(-1, c), "conv_b": dr.sum((0, 1)),
        "out": f["top"].T @ dlogit, "out_b": dlogit.sum(keepdims=True),
    }


#: Words of the made texts, identifiers and paths.
WORDS = (
    "the of and to in is that for it as was with be by on not he his at this are or an which you had but have from they we one all her she "
    "there would their will when who him been has more if no out so what up said its about into than them can only other new some could time "
    "these two may then do first any my now such like our over man me even most made after also did many before must through back years where "
    "much your way well down should because each just those people how too little state good very make world still own see men work long get "
    "here between both life being under never day same another know while last might us great old year off come since against go came right "
    "used take three user account service client server config manager factory handler request response session controller repository index "
    "build main test source common model view data image color table column row cache queue event message listener provider adapter context "
    "parser format string number value field class method package module import export static public private final abstract interface default"
).split()


HEXES = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF")


def _made(rng: random.Random) -> tuple[dict, dict]:
    """Makers of secrets and of look-alikes by name; those of TRAINED are trained on, the others calibrate."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lower + upper + digits
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    onset = ["", "", "b", "c", "ch", "d", "f", "g", "h", "l", "m", "n", "p", "pf", "qu", "r", "s", "sch", "st", "t", "th", "tr", "tz", "v", "w", "z"]
    vowel = ["a", "e", "i", "o", "u", "ai", "au", "eau", "ei", "ie", "io", "oi", "ou", "eu", "ea"]
    coda = ["", "", "", "b", "ch", "ck", "d", "l", "lle", "m", "n", "nd", "ng", "nt", "r", "re", "s", "st", "t", "tion", "x"]
    some = rng.randint
    syllables = lambda k: "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(k))
    word = lambda: rng.choice(WORDS) if rng.random() < 0.6 else syllables(some(1, 3))
    words = lambda k, gap: gap.join(word() for _ in range(k))
    camel = lambda k: "".join(word().capitalize() for _ in range(k))
    host = lambda: rng.choice(["www.", "cdn.", "mail.", "docs.", ""]) + words(some(1, 2), rng.choice("-.")) + rng.choice([".example.com", ".example.org", ".net", ".io", ".de"])
    secret = {
        "hub": lambda: rng.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + pick(mixed, 36),
        "live": lambda: rng.choice(["sk-", "sk_live_", "rk_live_", "sk_test_"]) + pick(mixed, some(24, 48)),
        "chat": lambda: "xox" + rng.choice("bpas") + "-" + pick(digits, 11) + "-" + pick(mixed, 24),
        "map": lambda: "AIza" + pick(mixed + "_-", 35),
        "web": lambda: "eyJ" + pick(mixed, some(20, 80)) + ".eyJ" + pick(mixed, some(20, 160)) + "." + pick(mixed + "_-", 43),
        "base": lambda: pick(mixed + "+/", rng.choice([40, 44, 64, 88])),
        "mixed": lambda: pick(mixed, some(16, 48)),
        "padded": lambda: pick(mixed + "+/", some(22, 60)) + "==",
        "upper": lambda: pick(upper + digits, some(16, 32)),
        "hexed": lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])),
        "lower": lambda: pick(lower + digits, some(20, 40)),
        "hook": lambda: "hooks." + host() + "/services/T" + pick(upper + digits, 8) + "/B" + pick(upper + digits, 8) + "/" + pick(mixed, 24),
        "deep": lambda: words(some(4, 9), "/") + "/" + pick(mixed, some(28, 40)),
        "short": lambda: pick(mixed, some(12, 15)),
        "brief": lambda: pick(mixed, some(10, 13)),
        "prefixed": lambda: pick(lower, some(2, 4)) + "_" + pick(rng.choice(HEXES), some(24, 48)),
        "tagged": lambda: pick(lower, some(2, 5)) + rng.choice(["_", "-", "_live_", "_v1_"]) + pick(rng.choice(HEXES), rng.choice([24, 32, 40, 48])),
        "capitals": lambda: pick("0123456789ABCDEF", some(24, 48)),
        # calibrating kinds
        "lab": lambda: "glpat-" + pick(mixed + "_-", 20),
        "mail": lambda: "SG." + pick(mixed + "_-", 22) + "." + pick(mixed + "_-", 43),
        "model": lambda: "hf_" + pick(mixed, 34),
        "shop": lambda: rng.choice(["shpat_", "npm_", "dckr_pat_"]) + pick(lower + upper + digits, rng.choice([27, 32, 36])),
        "url": lambda: rng.choice(["base64url-", ""]) + pick(mixed + "_-", some(32, 64)),
        "grouped": lambda: "-".join(pick(upper + digits, 5) for _ in range(some(4, 6))),
        "hubhex": lambda: "ghp_" + pick(rng.choice(HEXES), 36),
        "hex32": lambda: pick("0123456789ABCDEF", 32),
        "mixed12": lambda: pick(mixed, 12),
    }
    plain = {
        "path": lambda: rng.choice(["/", "", "./", "~/"]) + words(some(3, 8), "/") + rng.choice(["", ".py", ".html", ".txt", "/" + camel(3) + ".java", f"/{word()}_{some(1, 99)}.csv"]),
        "address": lambda: host() + "/" + words(some(1, 4), "/") + rng.choice(["", ".html", f"/{some(1, 99999)}", "/" + words(some(3, 7), "-"), f"/{some(1990, 2030)}/{some(10, 12)}/" + words(4, "-")]),
        "host": lambda: host() + rng.choice(["", f".mail{some(0, 99)}.example.org", f"-{some(1, 99)}.example.com"]),
        "long": lambda: rng.choice([str, str.capitalize, str.upper])(syllables(some(4, 10))),
        "uuid": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "snake": lambda: words(some(3, 8), "_"),
        "dashed": lambda: words(some(3, 8), "-") + rng.choice(["", f"-{some(1, 20)}"]),
        "dotted": lambda: words(some(3, 7), ".") + rng.choice(["", "." + camel(3)]),
        "date": lambda: f"{some(1990, 2030)}-{some(10, 12)}-{some(10, 28)}T{some(10, 23)}.{some(10, 59)}.{some(10, 59)}",
        "version": lambda: word() + "-" + word() + f"-{some(0, 9)}.{some(0, 20)}.{some(0, 20)}" + rng.choice(["", "-" + word() + word(), "-SNAPSHOT", f".dev{some(0, 99)}"]),
        "rule": lambda: rng.choice("=-_.~+") * some(16, 60),
        "digits": lambda: pick(digits, some(10, 24)),
        "camel": lambda: camel(some(3, 8)) + rng.choice(["", str(some(1, 99)), "Test", "Impl"]),
        "shout": lambda: rng.choice(["", "_"]).join(word().upper() for _ in range(some(3, 7))),
        "dots": lambda: "..." + word() + "..." + word() + "..." + word() + "..." + word(),
        "phone": lambda: f"+{some(1, 99)}-{some(100, 999)}-{some(100, 999)}-{some(1000, 9999)}",
        "serial": lambda: word() + str(some(10**5, 10**9)) + rng.choice(["", word()]),
        "dna": lambda: pick("ACGT", some(16, 80)),
        "card": lambda: pick("3456", 1) + pick(digits, 15),
        "stamped": lambda: words(some(1, 6), rng.choice("_-")) + rng.choice("_-") + f"{some(1990, 2030)}{some(10, 12)}{some(10, 28)}" + rng.choice(["", f"_{some(1000, 9999)}", f"-v{some(1, 9)}"]) + rng.choice(["", ".png", ".csv", ".log", ".zip", ".json.gz", ".docx"]),
        # calibrating kinds
        "code": lambda: camel(2) + "." + camel(1).lower() + camel(2) + "." + word() + camel(1),
        "query": lambda: host() + "/" + word() + "=" + word() + "/" + word() + "=" + str(some(1, 9999)),
        "pod": lambda: words(some(2, 4), "-") + "-" + str(some(1, 99)) + "-" + word(),
        "book": lambda: f"978-{some(0, 9)}-{some(100, 999)}-{some(10000, 99999)}-{some(0, 9)}",
        "doi": lambda: f"10.{some(1000, 9999)}/{word()}.{some(1990, 2030)}.{some(100, 99999)}",
        "joined": lambda: "".join(word() for _ in range(some(4, 9))),
        "file": lambda: words(some(2, 5), "_") + f"_{some(1990, 2030)}{some(10, 12)}{some(10, 28)}." + rng.choice(["pdf", "jpg", "xlsx", "tar.gz"]),
    }
    return secret, plain


TRAINED = frozenset(
    "hub live chat map web base mixed padded upper hexed lower hook deep short brief prefixed tagged capitals path address host long uuid snake dashed dotted date version rule "
    "digits camel shout dots phone serial stamped dna card".split()
)


def labelled_findings(n: int, seed: int, trained: bool) -> list[tuple[str, int, int, int, str]]:
    """(text, start, end, label, kind) made from rules: keys in code, settings and prose, and what only looks like them, two
    thirds; of the kinds that are trained on, or of the others."""
    rng = random.Random(seed)
    secret, plain = ([(k, f) for k, f in made.items() if (k in TRAINED) == trained] for made in _made(rng))
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    named = ["key", "auth", "Authorization: Bearer", "credential", "private_key", "access", "client", "pwd", "AUTH_KEY", "signing key", "webhook"]
    joins = [" = ", "=", ": ", ' = "', "='", " ", " is "]
    digest = ["sha256:", "commit ", "checksum ", "integrity sha512-", "etag ", "md5 ", "object id "]
    out = []
    while len(out) < n:
        label = rng.random() < 1 / 3
        if label:
            kind, make = rng.choice(secret)
            value = make()
            lead = rng.choice(named) + rng.choice(joins) if rng.random() < 0.6 else rng.choice(["", " ", '"', "(", "\n", "use ", "https://"])
        elif rng.random() < 0.1:
            kind, value, lead = "digest", "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice([32, 40, 64]))), rng.choice(digest)
        else:
            kind, make = rng.choice(plain)
            value = make()
            lead = rng.choice(["", " ", "see ", "https://", "at ", '"', "\n", "import ", "file: ", "name = ", "id: ", "("])
        value = value.rstrip(".=")
        if len(value) < LEAST_RUN and (len(value) < LEAST_MIXED or not MIXED.match(value)):
            continue
        before = prose(rng.randint(0, 8)) + rng.choice([" ", "\n", ". "]) + lead
        text = before + value + rng.choice(["", '"', " ", ".", "\n", ";", ")"]) + " " + prose(rng.randint(0, 12))
        out.append((text, len(before), len(before) + len(value), int(label), kind))
    return out


@lru_cache(maxsize=2)
def train(n: int = 14_000, held_out: int = 6000, recall: float = RECALL, epochs: int = 8, seed: int = 11) -> CharCnn:
    """Fit on the windows of ``n`` labelled findings, then calibrate on ``held_out`` of other kinds: a temperature by the
    least log loss, and a threshold whose recall there is at least ``recall`` for each kind of secret."""
    rng = np.random.default_rng(seed)
    d, c, k = 8, 32, 5
    w = {
        "emb": rng.normal(0, 0.5, (_CODES, d)), "conv": rng.normal(0, 1 / np.sqrt(k * (d + 1)), (k * (d + 1), c)),
        "conv_b": np.zeros(c), "out": rng.normal(0, 0.1, 3 * c), "out_b": np.zeros(1),
    }
    model = CharCnn({key: v.astype(np.float32) for key, v in w.items()}, span=k)
    shown, labels = [], []
    for text, start, end, label, _ in labelled_findings(n, seed, True):
        own = windows(text, start, end)
        own = own[-1:] if label else own  # a path before a key is no key: only the end of a long secret is sure to be one
        shown += own
        labels += [label] * len(own)
    x, y = np.stack(shown), np.array(labels, np.float32)
    m1 = {key: np.zeros_like(v) for key, v in model.w.items()}
    m2 = {key: np.zeros_like(v) for key, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            f = model.forward(x[rows])
            p = 1 / (1 + np.exp(-np.clip(f["logit"], -30, 30)))
            g = _gradients(model, x[rows], f, ((p - y[rows]) / len(rows)).astype(np.float32))
            step += 1
            rate = 0.005 * (1 - epoch / epochs)
            for key in model.w:
                m1[key] = 0.9 * m1[key] + 0.1 * g[key]
                m2[key] = 0.99 * m2[key] + 0.01 * g[key] ** 2
                model.w[key] -= (rate * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    held = labelled_findings(held_out, seed + 1, False)
    logit, y = model.logits([f[:3] for f in held]), np.array([f[3] for f in held])
    loss = lambda s: np.logaddexp(0, np.where(y > 0, -s * logit, s * logit)).mean()
    model.scale = float(min(np.geomspace(0.01, 4, 120), key=loss))
    # thresholds that keep the recall of every kind and let the fewest look-alikes pass form an interval; its middle is taken
    scores = model.scale * logit
    kinds = np.array([f[4] for f in held])
    worst = []
    for kind in sorted(set(kinds[y > 0])):
        found = np.sort(scores[(y > 0) & (kinds == kind)])
        worst.append(found[int((1 - recall) * len(found))])
    top = min(worst)
    low = scores[(y == 0) & (scores < top)].max(initial=top - 20)
    model.threshold = float(1 / (1 + np.exp(-(low + top) / 2)))
    return model


def scan_texts(texts: list[str | None], model: CharCnn) -> list[list[tuple[int, int, str]]]:
    """All spans (start, end, kind) of each text, by start and then kind."""
    base = [base_spans(t) if t else [] for t in texts]
    asked = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t, base[i])]
    out = [list(b) for b in base]
    for (i, a, b), p in zip(asked, model.score([(texts[i], a, b) for i, a, b in asked]), strict=True):
        if p >= model.threshold:
            out[i].append((a, b, "model"))
    for spans in out:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by ``[SECRET]``; spans that overlap or touch count as one."""
    out, end = [], 0
    for start, stop, _ in spans:
        if start > end or not out:
            out += [text[end:start], "[SECRET]"]
        end = max(end, stop)
    return "".join([*out, text[end:]]) if spans else text


def scan(docs: DataFrame, model: CharCnn | None = None, redact: bool = False) -> DataFrame:
    """The rows of ``docs`` (which needs ``text``) with ``secrets``: an array of (kind, start, end), in code points,
    end exclusive, by start and then kind (assign, access, hex, model). With ``redact`` the text is returned with its
    secrets replaced; the spans are those of the text as it was.

    Null and empty texts have none. Texts are scanned whole; the network's cost follows the number of candidates and
    their lengths. Repeated rows are scanned each. Columns pass through unchanged, but for one named ``secrets``, which
    the result replaces. An empty table gives no rows."""
    docs = docs.drop("secrets")
    model = model or train()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = scan_texts(texts, sent.value)
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found]
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*batch.schema.names, "secrets"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"secrets {SPANS}"])
    return arrow_pass(docs, apply, schema)


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"), count("model"),
    )
