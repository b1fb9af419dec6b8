"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from factloom.llm.phrases import collocations, grams, word_blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, top, least, share=50):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) > 1 and a >= least:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                longer = [b for q, b in count.items() if len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])]
                if not any(100 * b >= share * a for b in longer):
                    found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [chr(97 + i) * (1 + i % 2) for i in range(8)] + ["Ä", "ß", "x-y"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(r.randint(0, 60)))
    return [(i, text(), r.choice(["en", "en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("seed, top, least, widen", [(1, 5, 3, 2), (2, 40, 3, 2), (3, 2000, 2, 4), (4, 3, 10, 2)])
def test_brute(spark, seed, top, least, widen):
    rows = corpus(seed)
    assert run(spark, rows, top=top, least=least, widen=widen) == brute(rows, top, least)


def test_shared_flags(spark):
    """A table of flags too small for the pairs only counts more than it has to."""
    rows = corpus(7)
    assert run(spark, rows, top=10, least=3, widen=2, flags=4) == brute(rows, 10, 3)


def test_lowered_threshold(spark):
    """The best pairs all lie inside longer phrases, so the first threshold settles nothing."""
    rows = [(i, " ".join(f"p{i % 12} q{i % 12} r{i % 12}. u{k} v{i % 5}" for k in range(3)), "en") for i in range(240)]
    got = run(spark, rows, top=8, least=10, widen=2)
    assert got == brute(rows, 8, 10)
    assert sum(len(r[2].split()) == 2 for r in run(spark, rows, top=2000, least=10)) > 0


def test_nothing_to_count(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (None, "", "en"), (2, " \t.,", "en"), (3, "one two", "en")]) == []


def test_repeated_rows_ties_and_other_columns(spark):
    rows = [(None, "Aa bb, cc dd", "en", "x")] * 12
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, phrase string").withColumnsRenamed({"doc_id": "a b"})
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(df).collect())
    assert got == [("en", 1, "aa bb", 12, 12, 12, 48, 1_000_000), ("en", 2, "cc dd", 12, 12, 12, 48, 1_000_000)]


def test_very_long_text(spark):
    text = "ab cd " * 300_000 + "x"
    assert [b for b in word_blocks(text[:30])] == [text[:30].encode().split()]
    assert sum(map(len, word_blocks(text))) == 600_001
    got = run(spark, [(1, text, "en")])
    assert got == brute([(1, text, "en")], 2000, 10)


def test_grams():
    import numpy as np

    ids = np.array([1, 2, 0, 3, 4, 5, 0])
    assert [list(map(int, p)) for p in zip(*grams(ids, 2))] == [[1, 2], [3, 4], [4, 5]]
    assert [list(map(int, p)) for p in zip(*grams(ids, 3))] == [[3, 4, 5]]
    assert len(grams(ids[:1], 2)[0]) == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_collocations", "op13_benchmark_leaks"])
def test_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""
