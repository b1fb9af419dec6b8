"""Removal of repeated passages against a direct count of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import repeats


def brute(docs, length=400):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        n_spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(2)
    words = ["the", "of", "größe", "é", "lorem", "ipsum", "dolor"] + [f"w{i}x" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common, other = text(160), text(120)
    docs = [(None, common), (1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "b" * 401), (6, "ab" * 400), (7, "x" * 3000)]
    docs += [(10 + i, text(30 + i) + " " + common[rnd.randint(0, 40) :] + " " + text(25)) for i in range(90)]
    docs += [(200 + i, text(20) + other + text(20) + other[:430] + text(9)) for i in range(3)]
    near = text(400).split()
    for i in range(12):
        near[rnd.randrange(len(near))] = rnd.choice(words)
        docs.append((300 + i, " ".join(near)))
    docs += [(400, text(150))] * 2 + [(401, docs[40][1]), (402, docs[41][1] + "z")]
    return docs


@pytest.mark.parametrize(("limit", "size"), [(64, 128 << 10), (3, 2000)])
def test_brute_force(spark, limit, size):
    df = spark.createDataFrame(cases(), "doc_id bigint, text string").withColumn("kept", F.lit(1)).withColumn("h", F.lit("x")).repartition(3)
    got = repeats.remove_repeats(df, group_limit=limit, sort_bytes=size).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(cases())


def test_long_text(spark, monkeypatch):
    """A text longer than a block, with a repeat inside it."""
    rnd = random.Random(8)
    part = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    text = "".join(rnd.choice("ijklmnop") for _ in range(1 << 20)) + part + "Q" * 10 + part
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = repeats.remove_repeats(df).select("n_bytes", "n_removed", "n_spans", F.expr("octet_length(kept)").alias("left")).collect()
    assert tuple(row) == (len(text), 6000, 2, len(text) - 6000)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(df).collect() == []


def test_suffix_order():
    rnd = random.Random(1)
    for data in [b"a", b"banana\xff", b"aaaa", b"abababab\xffabab\xff", bytes(rnd.choice(b"abc") for _ in range(2000))]:
        assert repeats.suffix_order(data, 5000) == sorted(range(len(data)), key=lambda i: data[i:])


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame([(1, "é" * 300 + "x", "en", "s", 601), (2, "é" * 300 + "y", "en", "s", 601), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = repeats.without_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "x", 2: "y", 3: None}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x" * 500, 5, 6, 7), (2, "", 5, 6, 8)], "doc_id bigint, text string, `token-count` int, `a b` int, kept int")
    got = repeats.without_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "", 5, 6, 7), (2, "", 5, 6, 8)]


def test_prefixes():
    import numpy as np

    rnd = random.Random(4)
    for n in (0, 1, 5, 600):
        data = bytes(rnd.choice(b"ab") for _ in range(n)) + b"a" * 500
        for length in (3, 17, 400):
            order = np.array(repeats.suffix_order(data, length))
            pairs = [data[i : i + length] == data[j : j + length] and max(i, j) + length <= len(data) for i, j in zip(order, order[1:])]
            assert repeats.adjacent_reach(data, order, length).tolist() == [False, *pairs]


def test_texts_are_joined_the_same_way_at_any_size(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in cases()], "doc_id bigint, text string, source string")
    plan = repeats.remove_repeats(docs)._jdf.queryExecution()
    assert "SortMergeJoin" in plan.executedPlan().toString() and "BroadcastHashJoin" not in plan.executedPlan().toString()
    # below the join only the row has the text
    sides = plan.optimizedPlan().toString().split("Join ", 1)[1]
    assert " AS text" not in sides
