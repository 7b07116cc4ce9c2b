"""SimHash near-duplicates against brute force, and odd rows."""

import random
import re

import pytest
import xxhash

from markloom.llm import simhash

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def made(n, seed=5):
    """Texts with exact copies, chains of near ones and some that stand alone."""
    rng = random.Random(seed)
    rows, base = [], None
    for i in range(n):
        if base is None or rng.random() < 0.2:
            base = [rng.choice("abcdefghij") + rng.choice("klmnopqrst") * rng.randint(1, 3) for _ in range(rng.randint(1, 400))]
        elif rng.random() < 0.7:
            base = list(base)
            base[rng.randrange(len(base))] = "Ünlike" + str(i)
        rows.append((i * 3, " ".join(base)))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("blocks", "group"), [(None, 2048), (5, 4), (7, 16)])
def test_components_against_brute_force(spark, blocks, group):
    rows = made(250)
    want = brute_components(rows)
    assert len({c for *_, c in want}) < len(rows) - 60
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, DOCS), blocks=blocks, group=group)) == want


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(1)
    for blocks in (5, 6, 8):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(blocks)]
        for _ in range(300):
            a, b = rng.getrandbits(64), 0
            for bit in rng.sample(range(64), 4):
                b |= 1 << bit
            assert any((a ^ (a ^ b)) & m == 0 for m in masks)
    assert simhash.choose_blocks(1000) < simhash.choose_blocks(10**9)


def test_fingerprints_of_long_and_odd_texts():
    rng = random.Random(2)
    long = "  ".join(rng.choice("xyzÄÖ") * rng.randint(1, 9) for _ in range(simhash.STEP + 500))
    for text in (None, "", " \t\r\n\x0b\x0c", "One", "one TWO three", "a b c d", "é É ß \x1c x \x85 y", long):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one"), (6, "é" * 50), (None, "no id"), (None, "no id"), (7, "word " * 30000), (0, "word  WORD word\tword")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], DOCS + ", fp int, component string")
    assert got(simhash.near_duplicates(df)) == brute_components(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_a_star_of_many_is_not_compared_pair_by_pair(spark):
    import numpy as np

    left = np.array([1 << i for i in range(40)], np.uint64)
    assert len(simhash.stars(left, None, 4)) == 39
    assert len(simhash.stars(left[:20], left[20:], 4)) == 39
    assert simhash.stars(left, None, 1) == []


def test_query(spark, tmp_path):
    rows = made(60, 9)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    from markloom.llm.queries import QUERIES

    assert got(QUERIES["op13_simhash_near_dedup"](spark, str(tmp_path))) == brute_components(rows)
