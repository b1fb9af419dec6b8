"""Running operators and joins against brute force, with a hot key."""

import random

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import joins as J, ordered as O


def rows(n=500):
    rng = random.Random(3)
    return [(("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}"), i * 3 - 100, rng.randint(-5, 9)) for i in range(n)]


def test_running_sum_and_max_cross_blocks(spark):
    data = rows()
    df = spark.createDataFrame(data, "key string, pos long, v long")
    s = O.running_sum(df, ["key"], "pos", F.col("v"), "s", block=16)
    before = O.running_sum(df, ["key"], "pos", F.col("v"), "s", before_only=True, block=16)
    m = O.running_max(df, ["key"], "pos", F.col("v"), "s", block=16)
    for got, fn in ((s, lambda x: sum(x)), (before, lambda x: sum(x[:-1])), (m, max)):
        want = {}
        for key, pos, v in sorted(data, key=lambda r: r[1]):
            seen = want.setdefault(key, [])
            seen.append((pos, v))
        expected = {(k, p): fn([v for _, v in seen[: i + 1]]) for k, seen in want.items() for i, (p, _) in enumerate(seen)}
        assert {(r.key, r.pos): r.s for r in got.collect()} == expected


def test_global_rank(spark):
    df = spark.createDataFrame([(f"p{i % 37:02d}", i) for i in range(300)], "p string, i long")
    got = [(r.p, r.i) for r in O.global_rank(df, ["p", "i"], "r").orderBy("r").collect()]
    assert got == sorted((r.p, r.i) for r in df.collect())


def test_char_budget_cuts_only_the_first_that_overflows(spark):
    df = spark.createDataFrame([("m", i, "x" * n) for i, n in enumerate([300, 900, 400, 10])], "m string, pos long, t string")
    got = {r.pos: len(r.t) for r in O.char_budget(df, ["m"], "pos", "t", 1000, 500).collect()}
    assert got == {0: 300, 1: 700}


def test_last_before_takes_the_last_edge_not_the_nearest(spark):
    points = spark.createDataFrame([("f", 10), ("f", 1), ("g", 5)], "path string, line int")
    edges = spark.createDataFrame(
        [("f", 2, 9, "late"), ("f", 8, 3, "near"), ("f", 11, 99, "after"), ("g", 5, 1, "same")], "path string, line int, edge_seq long, caller string"
    )
    got = J.last_before(points, edges, ["path"], "line", "edge_seq", "caller", "c")
    assert {(r.path, r.line): r.c for r in got.collect()} == {("f", 10): "late", ("f", 1): None, ("g", 5): "same"}


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(k, p) for k, p, _ in rows()], "key string, pos long")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "key string, w int")
    for how in ("inner", "left"):
        got = sorted(map(str, J.salted_join(left, right, "key", how, share=4).collect()))
        assert got == sorted(map(str, left.join(right, "key", how).collect()))
    assert [r.key for r in J.hot_keys(left, "key", 4).collect()] == ["hot"]


def test_keys_hot_on_the_right_alone_are_spread(spark):
    left = spark.createDataFrame([(f"k{i}", i) for i in range(300)] + [("lib", 1), ("both", 1)] + [("both", i) for i in range(200)] + [(None, 5)], "key string, pos long")
    right = spark.createDataFrame([("lib", i) for i in range(900)] + [("away", i) for i in range(900)] + [("both", i) for i in range(300)] + [("k7", 1), ("k7", 1), (None, 1)], "key string, w int")
    got = J.salted_join(left, right, "key", share=8, right_keys=right)
    want = left.join(right, "key")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # rows of one key are dealt to several groups of the join, so no task holds them all
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("explode") == 2 and optimized.count("xxhash64") == 2


def test_contains_join_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abCé_") for _ in range(n))
    texts, names = sorted({word(rng.randint(1, 12)) for _ in range(80)}), sorted({word(rng.randint(1, 4)) for _ in range(30)})
    got = J.contains_join(
        spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n"
    )
    want = {(t, n) for t in texts for n in names if n.lower() in t.lower()}
    assert {tuple(r) for r in got.collect()} == want


def like(name: str, cand: str, tokens, threshold: float) -> bool:
    a, b = name.lower(), cand.lower()
    if a.endswith(b) or b.endswith(a) or ("::" in cand and cand.split("::")[-1].lower() == a):
        return True
    x, y = set(tokens[name]), set(tokens[cand])
    return bool(x and y) and len(x & y) / len(x | y) >= threshold


def test_fuzzy_match_against_brute_force(spark):
    rng = random.Random(11)
    words = ["get", "user", "name", "Http", "Parse", "req", "init", "a", "XML"]
    make = lambda: rng.choice(["_", "", "::", "."]).join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    names, cands = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})
    df = spark.createDataFrame([(n,) for n in sorted({*names, *cands})], "n string")
    tokens = {r.n: r.t for r in df.select("n", T.identifier_tokens(F.col("n")).alias("t")).collect()}
    for threshold in (0.5, 0.7):
        got = J.fuzzy_match(
            spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c,) for c in cands], "name string"), threshold
        )
        want = {}
        for n in names:
            fits = [c for c in cands if like(n, c, tokens, threshold)]
            if fits:
                want[n] = min(fits)
        assert {r.name: r.matched_to for r in got.collect()} == want
