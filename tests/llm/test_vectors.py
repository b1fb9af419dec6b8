"""Multi-index links against all pairs."""

import numpy as np

from factloom.llm.vectors import bounds, fit_codebook, link_vectors, multi_sequence, reach, units

from .test_simhash import union


def brute(rows, threshold=0.98):
    ok = [i for i, (_, e, label) in enumerate(rows) if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    pairs = [(i, j) for i in ok for j in ok if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    root = union(range(len(rows)), pairs)
    low = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    n = [0] * len(rows)
    for i, _ in pairs:
        n[i] += 1
    return sorted(((rows[i][0], n[i], low.get(root[i]), rows[i][0] == low.get(root[i])) for i in range(len(rows))), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted((tuple(r) for r in link_vectors(df, **kw).collect()), key=repr)


def cases(n=160, dim=16):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rnd.integers(len(rows))][1])
            x = base + rnd.normal(size=dim) * np.linalg.norm(base) * rnd.choice([0, 0.01, 0.045, 0.06])
        else:
            x = rnd.normal(size=dim)
        rows.append((int(i), [float(v) for v in np.float32(x)], int(rnd.integers(2))))
    return rows


def test_brute_force(spark):
    rows = cases()
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [float("inf")] + [1.0] * 15, 1),
           (1006, [1.0, 2.0], 1), (1007, [1.0, 2.01], 1), (1008, [], 1), (None, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (1010, [1e-30] * 16, 1), (1011, [1e-32] * 16, 1)]
    assert run(spark, rows + odd, cells=8) == brute(rows + odd)


def test_blocks(spark, monkeypatch):
    """A large group in one cell is cut into blocks."""
    import factloom.llm.vectors as v

    monkeypatch.setattr(v, "HOME_BLOCK", 7)
    monkeypatch.setattr(v, "VISIT_BLOCK", 11)
    rows = cases(90, 8)
    assert run(spark, rows, cells=2) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1, True)]
    assert run(spark, [(1, [2.0], 3), (2, [1.0], 3), (3, [-1.0], 3)]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_recall_of_visits():
    """Every neighbour's home cell is among the visited ones."""
    rows = cases(300, 16)
    x = units(np.array([e for _, e, _ in rows]))
    books = fit_codebook(x[:, :8], 16), fit_codebook(x[:, 8:], 16)
    near = [bounds(x[:, :8], books[0]), bounds(x[:, 8:], books[1])]
    limit = reach(x, books, 0.98)
    assert limit <= 0.0401
    found = wanted = 0
    for i in range(len(x)):
        cells = set(multi_sequence(near[0][1][i], near[1][1][i], limit))
        for j in np.flatnonzero(x @ x[i] >= 0.98):
            wanted += 1
            found += (int(near[0][0][j]), int(near[1][0][j])) in cells
    assert wanted > 300 and found == wanted


def test_label_types_doubles_and_exact_bound(spark):
    rows = cases(80)
    want = run(spark, rows)
    text = spark.createDataFrame([(i, e, None if c is None else f"label {c}") for i, e, c in rows], "vec_id bigint, embedding array<double>, label string")
    for recall in (None, 0.9999):
        assert sorted((tuple(r) for r in link_vectors(text, recall=recall).collect()), key=repr) == want
    # as floats the first two would be equal, and the third infinite
    wide = [(1, [1.0, 1e-9], 0), (2, [1.0, 2e-9], 0), (3, [1e300, 1e291], 0)]
    got = link_vectors(spark.createDataFrame(wide, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
