"""Near copies by five-word shingles against all pairs."""

import random

from factloom.llm import simhash

from .test_simhash import plain_fingerprint, union


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    a, b = five(a), five(b)
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def brute_kept(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3 or alike(docs[i][1], docs[j][1])]
    root = union(range(len(docs)), pairs)
    return sorted({min(docs[j][0] for j in root if root[j] == root[i]) for i in root})


def sample():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    docs = [(9000, "a b c d"), (9001, "a b c e"), (9002, "a b c d e"), (9003, "")]
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 300))]
        docs.append((i * 10, " ".join(base)))
        for k in range(rnd.randint(1, 4)):
            copy = [rnd.choice(words) if rnd.random() < rnd.choice([0.005, 0.02, 0.05]) else w for w in base]
            docs.append((i * 10 + k + 1, " ".join(copy)))
    return docs


def test_keep_one_finds_near_copies(spark):
    docs = sample()
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(docs)
    fps = {d: plain_fingerprint(t) for d, t in docs}
    far = [(a, b) for a, t in docs for b, u in docs if a < b and alike(t, u) and (fps[a] ^ fps[b]).bit_count() > 3]
    assert far  # pairs that three bits alone do not link


def test_sets_and_similarity():
    docs = sample()
    for (_, a), (_, b) in zip(docs, docs[1:], strict=False):
        x, y = simhash.shingle_set(a), simhash.shingle_set(b)
        assert len(x) == len(five(a))
        both = len(five(a) & five(b))
        assert simhash.shingles.similarity(x, y) == (both / (len(five(a)) + len(five(b)) - both) if both else 0.0)


def test_keep_one_with_repeated_and_missing_ids(spark):
    docs = [
        (1, "one clean text of its own"), (1, "quite another text that stays"),
        (2, "a text with a copy"), (None, "a text with a copy"),
        (None, "copies without any number"), (None, "copies without any number"),
    ]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([docs[0], docs[1], docs[2], docs[4]], key=repr)


def test_bands_of_unlike_texts(spark):
    """Groups of near copies that share a key with texts of other groups: one long common part, unlike rests."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    common = [rnd.choice(words) for _ in range(90)]
    docs = []
    for g in range(9):
        own = [rnd.choice(words) for _ in range(60)]
        for k in range(3):
            copy = own[:]
            copy[rnd.randrange(60)] = f"n{g}x{k}"
            docs.append((10 * g + k, " ".join(common + copy)))
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).count() == len(brute_kept(docs)) == 9


def test_settled_key(spark):
    """Under a single key all texts that are unlike each other are compared."""
    from pyspark.sql import functions as F

    from factloom.llm import shingles
    from factloom.llm.common import stage

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(7):
        own = [rnd.choice(words) for _ in range(40)]
        docs += [(2 * g, " ".join(own)), (2 * g + 1, " ".join([*own, "end"]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = F.xxhash64("text")
    texts = stage(df.select(t.alias("t"), F.col("doc_id").alias("c"), (F.size(F.split("text", " ")) - 4).cast("bigint").alias("n")))
    keyed = df.select(t.alias("t"), F.lit(1).cast("bigint").alias("key"))
    found = {tuple(sorted((r.a, r.b))) for r in shingles.links(df, texts, keyed, simhash.shingle_set).collect()}
    assert found == {(2 * g, 2 * g + 1) for g in range(7)}


def test_keep_one_keeps_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b", 5, 6, 9)], "doc_id bigint, text string, _own_text int, `a b` int, t int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b", 7, 8, 9)]


def links_of(spark, docs):
    """Pairs verified and links found between texts that share one key; each text is a component of its own."""
    from pyspark.sql import functions as F

    from factloom.llm import shingles
    from factloom.llm.common import stage

    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = F.xxhash64("text")
    texts = stage(df.select(t.alias("t"), F.col("doc_id").alias("c"), F.size(F.array_distinct(F.split("text", " "))).cast("bigint").alias("n")))
    sizes = {d: len(simhash.shingle_set(x)) for d, x in docs}
    texts = stage(texts.drop("n").join(spark.createDataFrame(list(sizes.items()), "c bigint, n bigint"), "c").select("t", "c", "n"))
    seen, verify = [], shingles._verify

    def counted(docs, pairs, set_of):
        seen.append(pairs.count())
        return verify(docs, pairs, set_of)

    shingles._verify = counted
    try:
        found = shingles.links(df, texts, df.select(t.alias("t"), F.lit(1).cast("bigint").alias("key")), simhash.shingle_set).collect()
    finally:
        shingles._verify = verify
    return sum(seen), {tuple(sorted((r.a, r.b))) for r in found}


def test_copies_too_far_apart_are_few_pairs(spark):
    """Texts made from one, none alike: their pairs grow with the texts, not with the square."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]

    def copies(n):
        out = []
        for i in range(n):
            copy = base[:]
            for k in rnd.sample(range(5, 145), 9):
                copy[k] = f"n{i}x{k}"
            out.append((i, " ".join(copy)))
        return out

    few, many = links_of(spark, copies(40)), links_of(spark, copies(160))
    assert few[1] == many[1] == set()
    assert many[0] <= 6 * few[0] and many[0] <= 2 * 160  # all pairs: 12,720


def test_texts_alike_share_a_rare_shingle(spark):
    """Near copies of many sizes: every pair that is alike is among the pairs to verify."""
    from pyspark.sql import functions as F

    from factloom.llm import shingles
    from factloom.llm.common import stage

    rnd = random.Random(13)
    docs = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(rnd.randint(30, 200))]
        for k in range(6):
            n = len(own)
            copy = own[: n - rnd.randint(0, n // 4)] + [f"g{g}e{k}x{i}" for i in range(rnd.randint(0, n // 8))]
            docs.append((10 * g + k, " ".join(copy)))
    docs += [(900 + i, f"a b c d e{' f' * i}") for i in range(3)]
    df = stage(spark.createDataFrame(docs, "doc_id bigint, text string"))
    left = df.select(F.xxhash64("text").alias("t"), F.col("doc_id").alias("c"))
    of = {r.t: r.c for r in left.collect()}
    pairs = {tuple(sorted((of[r.ta], of[r.tb]))) for r in shingles._rare_pairs(df, left, simhash.shingle_set).collect()}
    wanted = {(a, b) for a, t in docs for b, u in docs if a < b and alike(t, u)}
    assert len(wanted) > 30 and wanted <= pairs
    assert len(pairs) < 12 * 15 + 4  # none across the groups
