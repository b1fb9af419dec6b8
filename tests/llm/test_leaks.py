"""Benchmark passages against a plain search."""

import random
import re

import pytest

from factloom.llm.leaks import Items, Shard, longest_matches, scan, scan_shard, without_leaks, word_blocks


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    """(number of words, hit words, items) of a text."""
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        m = min(window, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add("" if name is None else str(name))
    return len(words), sorted(hit), sorted(found)


def cases(seed):
    r = random.Random(seed)
    known = [chr(97 + i) * r.randint(1, 2) for i in range(r.choice([2, 3, 6]))]
    text = lambda n: " ".join(r.choice(known) for _ in range(n))
    items = [(r.randint(0, 5), text(r.randint(0, r.choice([3, 15, 40])))) for _ in range(r.randint(0, 6))]
    texts = []
    for _ in range(r.randint(1, 6)):
        t = text(r.randint(0, 30))
        if items and r.random() < 0.5:
            t += ", É " + r.choice(items)[1].upper() + r.choice([" zz ", " 9 ", "\t"]) + text(5)
        texts.append(t)
    return texts, items, r.choice([2, 3, 10])


def blocks_of(items, window, size=3):
    return [Items([str(n) for n, _ in items[i : i + size]], [t.encode() for _, t in items[i : i + size]], window) for i in range(0, max(len(items), 1), size)]


def expanded(spans):
    return [k for lo, hi in spans for k in range(lo, hi)]


@pytest.mark.parametrize("seed", range(60))
def test_shard(seed):
    texts, items, window = cases(seed)
    n, spans, found = scan_shard([t.encode() for t in texts], iter(blocks_of(items, window)))
    assert [(a, expanded(s), f) for a, s, f in zip(n, spans, found)] == [brute(t, items, window) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_longest(seed):
    texts, items, window = cases(seed)
    words = [words_of(t) for t in texts]
    for block in blocks_of(items, window):
        shard = Shard([t.encode() for t in texts], block)
        name = {v: k.decode() for k, v in block.vocabulary.items()}
        for start, left, length in zip(block.start, block.left, shard.search(block)[0]):
            want = [name[i] for i in block.words[start : start + left]]
            best = 0
            for w in words:
                for i in range(len(w)):
                    k = 0
                    while k < left and i + k < len(w) and w[i + k] == want[k]:
                        k += 1
                    best = max(best, k)
            # shorter ones need not be found
            assert best == length or max(best, length) < block.least


def run(spark, docs, items, **kw):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((r.doc_id, r.n_words, expanded(r.spans), r["items"]) for r in scan(docs, items, **kw).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 60, "block_bytes": 30}])
def test_scan(spark, sizes):
    texts, items, _ = next(c for c in map(cases, range(99)) if len(c[0]) > 2 and len(c[1]) > 3)
    rows = [(i, t) for i, t in enumerate(texts * 5)] + [(None, None), (None, texts[0]), (1, ""), (1, texts[1]), (1, texts[1])]
    items = [*items, (None, texts[0]), (7, None), (7, ""), (8, "?!"), (3, items[0][1])]
    assert run(spark, rows, items, window=3, **sizes) == sorted(((d, *brute(t, items, 3)) for d, t in rows), key=repr)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, [], [])]


def test_long_text_and_block_ends(spark):
    passage = "the quick brown fox jumps over the lazy dog today"
    text = "x" * 1_048_570 + " " + passage + " y" * 600_000 + " " + passage
    assert sum(map(len, word_blocks(text.encode()))) == 600_021
    (row,) = run(spark, [(1, text)], [(5, passage)])
    assert row[1:] == (600_021, [*range(1, 11), *range(600_011, 600_021)], ["5"])


def test_matches_and_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"A {passage.upper()} z"), (2, "one two three"), (3, f"b c {passage[:-7]}"), (None, passage)]
    items = [(9, passage), (8, "Three")]
    made = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id bigint, text string, n_hit int, `text-hash` string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.item, r.item_start): (r.length, r.doc_id, r.doc_start) for r in longest_matches(made, bench).collect()}
    assert found[("9", 0)][0] == 11 and found[("9", 1)][0] == 10 and found[("8", 0)][0] == 1
    kept = without_leaks(made, spark.createDataFrame(items[:1], "item_id bigint, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "one two three", 1, "k")]
    assert kept.columns == made.columns
