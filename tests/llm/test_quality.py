"""Quality rules against a direct count; classifier on held-out labels."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import classifier, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 20 or 100 * len(repeat) > 30 * n)


def texts():
    rnd = random.Random(4)
    words = ["the", "of", "größe", "#a", "b|", "x"]
    out = [None, "", " ", "\n\n", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 30, "l one\n" * 5, "\x0b\x0c\r\t", "é\x85b c d", "<|>" * 40, "w " * 5000]
    return out + ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("own")).withColumn("n_words", F.lit(-1))
    got = rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    kept = rules.keep_by_rules(df)
    assert kept.columns == df.columns
    assert all(r.kept == "own" for r in kept.collect())
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_no_python(spark):
    plan = rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    judged = rules.quality_rules(docs).filter("not base_failed").join(labels.filter("quality = 1"), "doc_id")
    assert judged.filter("not kept").count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    out = classifier.score_documents(docs, classifier.train(docs, labels)).select("_row.doc_id", "score", "predicted")
    return out.join(labels, "doc_id").collect()


def test_held_out(scored):
    out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 500
    assert np.mean([r.predicted == r.quality for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(None, "x"), (1, None), (2, ""), (3, "word " * 20000), (3, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0), (9, 1)], "doc_id bigint, quality int")
    out = classifier.score_documents(docs, classifier.train(docs, labels))
    assert out.count() == 5 and out.filter("score is null or isnan(score)").count() == 0
    assert classifier.keep_by_score(docs, labels).columns == docs.columns
    empty = classifier.score_documents(docs, classifier.train(docs, labels.limit(0)))
    assert {r.score for r in empty.collect()} == {0.5}


def test_pairs_are_learnt():
    """An interaction that no single feature shows."""
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(3000, len(classifier.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = classifier.fit(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9
    assert (model.score(x) == classifier.fit(x[:2000], y[:2000]).score(x)).all()


def test_score_by_plain_look_ups():
    """Row by row: a bin is the number of edges at or below the value, and tables are added up."""
    rnd = np.random.default_rng(2)
    x = np.round(rnd.uniform(size=(400, len(classifier.FEATURES))), 2)
    model = classifier.fit(x[:300], (x[:300, 1] + x[:300, 4] * x[:300, 5] > 0.8).astype(float))
    for row, score in zip(x, model.score(x), strict=True):
        spot = lambda edges, value: sum(e <= value for e in edges)
        total = model.base + sum(t[spot(model.edges[j], row[j])] for j, t in enumerate(model.tables))
        total += sum(t[spot(model.coarse[a], row[a]), spot(model.coarse[b], row[b])] for a, b, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def _leaf(g, h):
    return g * g / (h + classifier.RIDGE)


def test_first_split_of_a_tree_by_trying_all():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        g, h = rnd.normal(size=9), rnd.uniform(0.01, 1, 9)
        gains = [_leaf(g[:k].sum(), h[:k].sum()) + _leaf(g[k:].sum(), h[k:].sum()) - _leaf(g.sum(), h.sum()) for k in range(1, 9)]
        k = int(np.argmax(gains)) + 1
        k = k if max(gains) > 1e-9 else 9  # no cut where the ridge makes none worth it
        want = np.concatenate([np.full(k, -g[:k].sum() / (h[:k].sum() + classifier.RIDGE)), np.full(9 - k, -g[k:].sum() / (h[k:].sum() + classifier.RIDGE))])
        assert np.allclose(classifier._tree(g, h, leaves=2), want)


def test_quadrants_by_trying_all_cuts():
    rnd = np.random.default_rng(6)
    for _ in range(30):
        g, h = rnd.normal(size=(4, 5)), rnd.uniform(0.01, 1, (4, 5))
        best, want = -np.inf, None
        for i in range(1, 4):
            for j in range(1, 5):
                boxes = [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
                gain = sum(_leaf(g[b].sum(), h[b].sum()) for b in boxes) - _leaf(g.sum(), h.sum())
                if gain > best:
                    best, want = gain, np.zeros_like(g)
                    for b in boxes:
                        want[b] = -g[b].sum() / (h[b].sum() + classifier.RIDGE)
        gain, table = classifier._quadrants(g, h)
        assert abs(gain - best) < 1e-9 and np.allclose(table, want)


def test_odd_column_names(spark):
    """The rows' own columns stay as they are, whatever their names."""
    docs = spark.createDataFrame([(1, "some text " * 30, 5, 6, "x"), (2, "", 7, 8, "y")], "doc_id bigint, text string, `token-count` int, `a b` int, score string")
    found = classifier.score_documents(docs, classifier.Model())
    assert sorted(tuple(r) for r in found.select("_row.*").collect()) == sorted(tuple(r) for r in docs.collect())
    assert {r.score for r in found.collect()} == {0.5}
    assert classifier.keep_by_score(docs, spark.createDataFrame([], "doc_id bigint, quality int")).columns == docs.columns
