"""SimHash components against all pairs on small inputs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash
from factloom.llm.components import components


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    ids = [d for d, _ in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = union(range(len(docs)), pairs)
    low = {}
    for i, r in root.items():
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return sorted(((ids[i], f"{fps[i]:016x}", low.get(root[i])) for i in range(len(docs))), key=repr)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("component", F.lit(1))
    out = simhash.simhash_components(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(None, "a b c"), (900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (904, "one"), (905, "A b"), (906, "É b\x85c d")]
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 300))]
        docs.append((i * 10, " ".join(base)))
        for k in range(rnd.randint(0, 5)):
            base[rnd.randrange(len(base))] = rnd.choice(words)
            docs.append((i * 10 + k + 1, "\n".join(base)))
    assert run(spark, docs) == brute(docs)


def test_all_distances(spark):
    """Balls around random centres, with every distance up to 5, and long chains."""
    rnd = np.random.default_rng(3)
    fps = []
    for _ in range(12):
        c = int(rnd.integers(0, 1 << 63)) * 2 + int(rnd.integers(2))
        for _ in range(12):
            x = c
            for b in rnd.choice(64, int(rnd.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    x = 7
    for k in range(30):
        fps.append(x)
        for b in range(3):
            x ^= 1 << ((3 * k + b) % 64)
    fps = sorted({simhash.signed(f) for f in fps} | {2**63 - 1, -(2**63), 2**63 - 2})
    low = union(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")))
    have = {f: f for f in fps} | {r.node: r.component for r in got.collect()}
    assert have == low


def test_no_rows(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    docs = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "other words here now", "z"), (None, "k l m", "n")]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([docs[1], docs[3], docs[4]], key=repr)
