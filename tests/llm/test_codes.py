"""Vector codes against plain Python integers."""

import math

import numpy as np
import pytest

from factloom.llm.codes import compress, decoded, exact_dots, fit, limb_bits, limbs, nearest, with_label_error


def brute(rows, parts, entries, rounds, scale=4096):
    """(vec_id, code, error, label_error) and the codebooks, with Python's integers only."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    xs = [[math.floor(scale * x) for x in r[1]] for r in kept]
    sizes = [len(x) for x in xs if x and len(x) % parts == 0]
    dim = min(sorted(set(sizes), key=lambda n: (-sizes.count(n), n))[:1] or [0])
    sound = [i for i in range(len(kept)) if dim and len(xs[i]) == dim]
    width = dim // parts if dim else 0
    part = lambda i, p: xs[i][p * width : (p + 1) * width]
    first = sorted(sound, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, xs[i]))[:entries]
    books = [[part(i, p) for i in first] for p in range(parts)] if dim else []

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for i in sound:
                members[best(part(i, p), book)[0]].append(part(i, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, book)]
    out = {}
    for i in sound:
        found = [best(part(i, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), min(sum(d for _, d in found), (1 << 63) - 1))
    sums = {}
    for i, r in enumerate(kept):
        sums[r[2]] = sums.get(r[2], 0) + (out[i][1] if i in out else 0)
    return sorted(((r[0], *out.get(i, (None, None)), min(sums[r[2]], (1 << 63) - 1)) for i, r in enumerate(kept)), key=repr), books


def run(spark, rows, schema="vec_id bigint, embedding array<double>, label string", **kw):
    coded, books = compress(spark.createDataFrame(rows, schema), **kw)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in with_label_error(coded).collect()), key=repr), books


@pytest.mark.parametrize("top", [1 << 12, 1 << 27, 1 << 29, 1 << 45, 1 << 61])
def test_nearest(top):
    rnd = np.random.default_rng(top)
    x, book = rnd.integers(-top, top, (40, 8)), rnd.integers(-top, top, (16, 8))
    book[5] = book[2]  # a tie goes to the lower index
    at, d = nearest(x, book)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in book] for v in x]
    assert [int(v) for v in d] == [min(w) for w in want]
    assert at.tolist() == [w.index(min(w)) for w in want]


def test_limbs():
    x = np.array([0, 1, -1, (1 << 61) + 12345, -(1 << 61) - 54321])
    for length in (1, 2, 8, 9, 64, 1000):
        bits = limb_bits(length)
        assert length * (1 << 2 * bits) <= 1 << 53
        assert [sum(int(v) << bits * i for i, v in enumerate(p)) for p in zip(*limbs(x, bits))] == x.tolist()
    a, b = np.full((1, 8), (1 << 28) - 1), np.full((1, 8), 1 - (1 << 28))
    assert int(exact_dots(a, b)[0, 0]) == -8 * ((1 << 28) - 1) ** 2


def test_brute(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rnd.normal(size=8)], str(rnd.integers(3))) for i in rnd.permutation(90)]
    rows += [rows[0], rows[0], (None, [0.5] * 8, None), (500, None, "a"), (501, [1.0, None] * 4, "a"), (502, [1.0, float("nan")] * 4, "a"), (503, [float("inf")] * 8, "a")]
    rows += [(504, [1.0] * 4, "a"), (505, [], None), (506, [1e300] * 8, "b"), (-7, [0.0] * 8, None)]
    kw = {"parts": 4, "entries": 5, "rounds": 6}
    got, books = run(spark, rows, **kw)
    # too large a component stays without a code
    want, want_books = brute([r if r[0] != 506 else (506, [0.0] * 3, "b") for r in rows], **kw)
    assert got == want
    assert books == want_books


def test_large_components(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rnd.normal(size=4) * 10.0 ** rnd.integers(0, 7)], None) for i in range(60)]
    kw = {"parts": 2, "entries": 4, "rounds": 3}
    assert run(spark, rows, **kw) == brute(rows, **kw)


def test_few_and_none(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, None, "a")]) == ([], [])
    assert run(spark, [(1, [1.0, 2.0, 3.0], "a")])[0] == [(1, None, None, 0)]
    same = [(i, [0.25] * 8, "a") for i in range(3)]
    got, books = run(spark, same)
    assert got == [(i, "00" * 8, 0, 0) for i in range(3)] and len(books[0]) == 3
    assert decoded(got[0][1], books) == [(1024 + 0.5) / 4096] * 8


def test_other_columns_and_labels(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, 7, "x", 1), (2, [0.25] * 8, 7, "y", 2)], "vec_id int, embedding array<float>, label int, code string, `a b` int")
    coded, _ = compress(df)
    assert sorted((r.vec_id, r.label_error) for r in with_label_error(coded).collect()) == [(1, 0), (2, 0)]


def test_hot_label_and_order(spark):
    rows = [(i, [i / 7.0] * 8, None if i % 3 else "b") for i in range(40)]
    kw = {"parts": 8, "entries": 16, "rounds": 2}
    assert run(spark, rows, **kw) == run(spark, rows[::-1], **kw) == brute(rows, **kw)


def test_fit_leaves_unused_entries(spark):
    rows = spark.createDataFrame([(0, [0, 0]), (1, [0, 0]), (2, [100, 100])], "vec_id bigint, x array<bigint>")
    assert fit(rows, 2, parts=1, entries=2, rounds=1) == [[[33, 33], [0, 0]]]
