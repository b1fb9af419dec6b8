"""Near-duplicate vectors by an inverted multi-index.

A codebook of CELLS centroids for each half of the unit vectors makes a grid of
CELLS x CELLS cells. Every vector has one home cell and, as a query, visits cells
by multi-sequence traversal: pairs of centroids in ascending order of what the two
halves of a neighbour at least lie away from the query. A vector in the cell of a
centroid i, and not of the nearest one b, is at least (|x-i|^2 - |x-b|^2) / (2 |i-b|)
from x. The traversal ends at the sum of both halves' squares that reaches the
target recall: the RECALL quantile of that sum over simulated neighbours, which lie
exactly at the threshold from the rows of the sample in random directions, times
MARGIN; nearer neighbours are found more surely still. It never goes beyond
2 - 2 * threshold, where no cell holds a neighbour. Pairs that meet in a cell are
then verified by cosine in double precision. Measured recall on the test tables: 1.

Equal vectors of a label are one entry with a count. Entries of a cell are cut into
blocks, a block of homes against a block of visitors, so no cell sits in one task;
a block gives counts and the links of a spanning forest, never its pairs.

The codebooks are fitted on at most FIT_ROWS entries, chosen by hash. Vectors of
another length than the commonest of that sample share one cell per label and
length, cut into blocks likewise.

A vector that is null, all zero or has a null or non-finite component, or a null
label, has no links and is its own component. Repeated rows are vectors of their
own: they link with each other. A label may have any type that can be compared; labels
that are no whole numbers count as equal if a hash of 64 bits is. Doubles are compared as
doubles. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import own_shuffle, prepare, stage
from factloom.llm.components import components

THRESHOLD = 0.98
CELLS = 64
FIT_ROWS = 8192
HOME_BLOCK = 512
VISIT_BLOCK = 1024
RECALL = 0.9999
MARGIN = 1.25
SIMULATED = 16_384
_SLACK = 1e-9


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # scaled first, so that tiny or huge components keep their squares
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * x @ book.T, 0)


def fit_codebook(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """k-means from a farthest-first start; the same rows give the same centroids."""
    distinct = np.unique(x, axis=0)
    chosen, away = [0], _squares(distinct, distinct[:1])[:, 0]
    while len(chosen) < min(cells, len(distinct)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _squares(distinct, distinct[chosen[-1] :][:1])[:, 0])
    book = distinct[chosen].copy()
    for _ in range(rounds):
        near = _squares(x, book).argmin(1)
        for c in range(len(book)):
            if (near == c).any():
                book[c] = x[near == c].mean(0)
    return book


def bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the squared least distance to any point of each centroid's cell."""
    d = _squares(x, book)
    near = d.argmin(1)
    apart = np.sqrt(_squares(book, book))
    away = (d - d[np.arange(len(x)), near][:, None]) / (2 * np.maximum(apart[near], 1e-12))
    away[np.arange(len(x)), near] = 0
    return near, np.where(apart[near] < 1e-6, 0, np.maximum(away - _SLACK, 0)) ** 2


def reach(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float = RECALL) -> float:
    """The bound up to which the traversal finds ``recall`` of the neighbours at the threshold."""
    half, rnd = x.shape[1] // 2, np.random.default_rng(11)
    x = np.tile(x, (-(-SIMULATED // len(x)), 1))[:SIMULATED]
    aside = rnd.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside
    total, k = np.zeros(len(x)), np.arange(len(x))
    for book, part in zip(books, (slice(0, half), slice(half, None)), strict=True):
        total += bounds(x[:, part], book)[1][k, bounds(y[:, part], book)[0]]
    return float(min(2 - 2 * threshold, MARGIN * np.quantile(total, recall, method="higher"))) + _SLACK


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells in ascending order of the sum of both halves' bounds, as far as ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > limit:
            return
        yield int(a[i]), int(b[j])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (first[a[k]] + second[b[m]], k, m))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


ENTRY = "label bigint, dim int, cell int, visits boolean, gid bigint"
_SCHEMA = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("visits", pa.bool_()), ("gid", pa.int64())])


def _spread(books: tuple[np.ndarray, np.ndarray], dim: int, limit: float):
    """Each entry at home and at every cell it visits; vectors stay behind."""
    half = dim // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                at_dim = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False) == dim)
                cells, visits, of = [], [], []
                other = np.setdiff1d(np.arange(batch.num_rows), at_dim)
                for i in other:
                    cells += [-1, -1]
                    visits += [False, True]
                    of += [i, i]
                if len(at_dim):
                    x = units(_matrix(batch.column(3).take(pa.array(at_dim))))
                    near1, low1 = bounds(x[:, :half], books[0])
                    near2, low2 = bounds(x[:, half:], books[1])
                    n = len(books[1])
                    for k, i in enumerate(at_dim):
                        cells.append(int(near1[k]) * n + int(near2[k]))
                        visits.append(False)
                        of.append(i)
                        for a, b in multi_sequence(low1[k], low2[k], limit):
                            cells.append(a * n + b)
                            visits.append(True)
                            of.append(i)
                rows = batch.take(pa.array(np.array(of, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(cells, pa.int32()), pa.array(visits, pa.bool_()), rows.column(2)], schema=_SCHEMA)

    return run


_OUT = pa.schema([("gid", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite block: a label for each row and column, the least column index reachable; the width where there is none."""
    width = hit.shape[1]
    cols, rows = np.arange(width), np.full(hit.shape[0], width)
    while True:
        rows_now = np.where(hit, cols[None, :], width).min(1, initial=width)
        cols_now = np.minimum(cols, np.where(hit, rows_now[:, None], width).min(0, initial=width))
        if (rows_now == rows).all() and (cols_now == cols).all():
            return rows, cols
        rows, cols = rows_now, cols_now


def _verify(threshold: float):
    """Rows sorted by block: (gid, number of linked vectors, null) of visitors, and (gid, null, other) links of a forest."""
    def block(gid: np.ndarray, copies: np.ndarray, visits: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        home, seen = np.flatnonzero(~visits), np.flatnonzero(visits)
        if not len(home) or not len(seen):
            return []
        x = units(vectors)
        hit = (x[seen] @ x[home].T >= threshold) & (gid[seen][:, None] != gid[home][None, :])
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return []
        hit, seen = hit[some], seen[some]
        counts = hit @ copies[home]
        rows, cols = forest(hit)
        out = [(int(g), int(n), None) for g, n in zip(gid[seen], counts, strict=True)]
        touched = np.flatnonzero(hit.any(0))
        pairs = [(gid[i], gid[home[r]]) for i, r in zip(seen, rows, strict=True)] + [(gid[home[c]], gid[home[cols[c]]]) for c in touched if cols[c] != c]
        return out + [(int(a), None, int(b)) for a, b in pairs if a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            yield from finish(held, False)
            held = rest(held)
        if held is not None and held.num_rows:
            yield from finish(held, True)

    def edges(data: pa.Table) -> np.ndarray:
        keys = np.stack([data.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
        return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])

    def rest(data: pa.Table) -> pa.Table:
        return data.slice(edges(data)[-2]) if data.num_rows else data

    def finish(data: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        at = edges(data) if data.num_rows else np.zeros(1, np.int64)
        data, out = data.combine_chunks(), []
        gid, copies, visits = data.column("gid").to_numpy(), data.column("copies").to_numpy(), data.column("visits").to_numpy()
        vectors = data.column("vector")
        for lo, hi in zip(at[:-1], at[1:] if last else at[1:-1], strict=False):
            if hi - lo > 1:
                some = vectors.slice(lo, hi - lo).combine_chunks()
                out += block(gid[lo:hi], copies[lo:hi], visits[lo:hi], _matrix(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_OUT)

    return run


def entries(vectors: DataFrame) -> DataFrame:
    """Distinct valid vectors by label: gid, label, dim, copies, low (least vec_id), embedding."""
    grouped = vectors.filter("valid").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    return stage(grouped.select(F.monotonically_increasing_id().alias("gid"), "label", F.size("embedding").alias("dim"), "copies", "low", "embedding"))


def _read(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    kinds = dict(vectors.dtypes)
    # labels are only compared: whole numbers as they are, others by a hash of 64 bits; floats stay short
    label = F.col("label").cast("bigint") if kinds["label"] in ("tinyint", "smallint", "int", "bigint") else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    wide = kinds["embedding"] if kinds["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(wide).alias("embedding"), label.alias("label"))
    return rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, fit_rows: int = FIT_ROWS, recall: float | None = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. Without ``recall`` cells are visited up to the bound that misses no neighbour."""
    spark = prepare(vectors.sparkSession)
    rows = _read(vectors)
    found = entries(rows)
    sample = found.select("embedding").orderBy(F.xxhash64("gid")).limit(fit_rows).collect()
    lengths = [len(r.embedding) for r in sample]
    dim = max(sorted({n for n in lengths if n > 1} or {0}), key=lengths.count)
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return alone
    books, limit = (np.zeros((1, 0)), np.zeros((1, 0))), 0.0
    if dim:
        x = units(np.array([r.embedding for r in sample if len(r.embedding) == dim], np.float64))
        books = (fit_codebook(x[:, : dim // 2], cells), fit_codebook(x[:, dim // 2 :], cells))
        limit = reach(x, books, threshold, recall) if recall is not None else 2 - 2 * threshold + _SLACK
    placed = stage(found.select("label", "dim", "gid", F.col("embedding").alias("vector")).mapInArrow(_spread(books, dim or -1, limit), ENTRY))
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("seen"))
    # cells without a home are left out; stored, so that the join below shuffles both sides and can split a hot cell
    sizes = stage(sizes.filter("homes > 0").select(
        "label", "dim", "cell", F.ceil(F.col("homes") / HOME_BLOCK).cast("int").alias("hb"), F.ceil(F.col("seen") / VISIT_BLOCK).cast("int").alias("vb")))
    spot = F.xxhash64("gid")
    own = F.when(F.col("visits"), F.pmod(spot, F.col("vb"))).otherwise(F.pmod(spot, F.col("hb"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("visits"), F.col("hb")).otherwise(F.col("vb")) - 1)
    dealt = placed.join(sizes, ["label", "dim", "cell"]).select("*", own.alias("own"), F.explode(every).alias("each"))
    dealt = dealt.join(found.select("gid", "copies", F.col("embedding").alias("vector")), "gid").select(
        "label", "dim", "cell", F.when(F.col("visits"), F.col("each")).otherwise(F.col("own")).alias("h"), F.when(F.col("visits"), F.col("own")).otherwise(F.col("each")).alias("v"),
        "visits", "gid", "copies", "vector")
    keys = ["label", "dim", "cell", "h", "v"]
    met = stage(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "gid bigint, n bigint, other bigint"))
    counts = met.filter("n is not null").groupBy("gid").agg(F.sum("n").alias("n"))
    member = components(met.filter("other is not null").select(F.col("gid").alias("a"), F.col("other").alias("b")))
    named = found.select("gid", "label", "embedding", "copies", "low").join(counts, "gid", "left").join(member, F.col("gid") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "gid"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    total = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("bigint")
    facts = stage(named.join(own_shuffle(least, "component"), "component").select("label", "embedding", total.alias("n_links"), "component_id"))
    linked = rows.filter("valid").join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
