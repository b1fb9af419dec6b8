"""Joins by name, position, containment and likeness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import text as T
from factloom.operators.ordered import running_max
from factloom.session import stage_table

HOT_SHARE = 64
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than 1/share of the rows: never more than ``share`` keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    limit = counts.agg((F.sum("_n") / share).alias("_limit")).scalar()
    return counts.where(F.col("_n") > limit).select(key)


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner",
    salts: int = SALTS, share: int = HOT_SHARE, right_keys: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on one column that spreads the hot keys of the left side, or of both.

    Left rows of a hot key go to ``salts`` groups by a hash of the row (not by
    ``rand``: a re-run task must make the same choice); right rows of hot keys
    are repeated once per group. ``right_keys``, for inner joins, is a table with
    the keys of the right side, in about their shares: those hot in it alone are
    spread the other way round. Each hot-key list has at most ``share`` rows, so
    it is broadcast whatever the table size. For joins where both sides have many
    rows per key; the left side is read twice, and ``right_keys`` once, so they
    should be stored tables and not scans of source text.
    """
    hot = hot_keys(left, key, share).select(F.col(key).alias("_hot"), F.lit(0).alias("_side"))
    if right_keys is not None:
        there = hot_keys(right_keys, key, share).select(F.col(key).alias("_hot"), F.lit(1).alias("_side"))
        # a key that is hot on both sides is spread on the left
        hot = hot.unionByName(there).groupBy("_hot").agg(F.min("_side").alias("_side"))
    hot = F.broadcast(hot)
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))

    def salted(df: DataFrame, side: int) -> DataFrame:
        others = [c for c in df.columns if c != key] or [key]
        own = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
        groups = F.when(F.col("_side").isNull(), F.array(F.lit(0))).when(F.col("_side") == side, F.array(own)).otherwise(all_salts)
        return df.join(hot, df[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(groups)).drop("_hot", "_side")

    return salted(left, 0).join(salted(right, 1), [key, "_salt"], how).drop("_salt")


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join with a right side that has one row, or few, per key.

    Left to adaptive execution on purpose: it broadcasts the right side only
    after it has measured it, and otherwise splits a hot key of the left side
    over many tasks, each with the one right row it needs. A salt would need a
    pass over the left side to find the hot keys first.
    """
    return left.join(right, key, how)


def last_before(
    points: DataFrame, edges: DataFrame, keys: Sequence[str], position: str,
    edge_order: str, value: str, out: str, bounded: bool = False,
) -> DataFrame:
    """For each point, the value of the edge with the highest order among the
    edges of the same key at or before its position.

    Both sides are stacked and a running maximum passes over the positions:
    linear, no pairs. Edges sort before points of the same position. Keys that
    may hold any number of rows are passed in blocks; ``bounded`` says that a
    key cannot grow (a file under the size guard), so one window does.
    """
    p = points.withColumn("_edge", F.lit(None).cast("struct<o:bigint,v:string>")).withColumn("_side", F.lit(1))
    e = edges.select(
        *keys, F.col(position),
        F.struct(F.col(edge_order).cast("bigint").alias("o"), F.col(value).cast("string").alias("v")).alias("_edge"),
    ).withColumn("_side", F.lit(0))
    both = p.unionByName(e, allowMissingColumns=True)
    both = both.withColumn("_at", F.col(position).cast("bigint") * 2 + F.col("_side"))
    if bounded:
        window = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = both.withColumn("_last", F.max("_edge").over(window))
    else:
        filled = running_max(both, keys, "_at", F.col("_edge"), "_last")
    return filled.where(F.col("_side") == 1).withColumn(out, F.col("_last.v")).select(*points.columns, out)


def contains_join(
    texts: DataFrame, text: str, names: DataFrame, name: str, ignore_case: bool = True, sieve: bool = False
) -> DataFrame:
    """(text, name) pairs where the text contains the name.

    Every distinct text gives out its substrings of the lengths that occur
    among the names, and those are equi-joined with the names; no pair is
    formed that is not a result. Meant for short texts such as words and names.
    With ``sieve`` substrings that begin or end like no name stay out of the
    join; it reads the names once more, so they should be cheap to make.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    wanted = names.select(F.col(name).alias("_name"), fold(F.col(name)).alias("_key")).where(
        F.length("_key") > 0
    ).distinct()
    if sieve:
        exploded = _sieved_pieces(texts.select(F.col(text).alias("_text")), wanted.select("_key"), fold).distinct()
        return exploded.join(wanted, "_key").select(F.col("_text").alias(text), F.col("_name").alias(name))
    distinct = texts.select(F.col(text).alias("_text")).distinct().withColumn("_lens", _lengths(wanted, "_key"))
    size = F.length("_text")
    pieces = F.flatten(
        F.transform(
            F.filter("_lens", lambda n: n <= size),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(fold(F.col("_text")), at, n)
            ),
        )
    )
    exploded = distinct.select("_text", F.explode(F.array_distinct(pieces)).alias("_key"))
    return exploded.join(wanted, "_key").select(F.col("_text").alias(text), F.col("_name").alias(name))


# characters at both ends of a name that the sieve knows
HEAD, TAIL = 4, 3


def _sieved_pieces(texts: DataFrame, names: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """(_text, _key): substrings of a name's length that begin like a name and end like one of that length.

    Beginnings and endings are known by hash, a byte per slot, so a table of
    names of any size leaves two tables of fixed size; none of the names is missed.
    """
    ends = lambda key: (_slot(F.left(key, F.lit(HEAD))), _slot(F.concat(F.right(key, F.lit(TAIL)), F.length(key).cast("string"))))
    head, tail = ends(F.col("_key"))
    met = names.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("slot")), F.struct(F.lit(1).alias("side"), tail.alias("slot")))).alias("m"))
    known = bytearray(SKETCH), bytearray(SKETCH)
    for side, slot in met.select("m.*").distinct().collect():  # two rows per slot at most, whatever the number of names
        known[side][slot] = 1
    has = lambda side, slot: F.substring(F.lit(bytes(known[side])), slot + 1, F.lit(1)) == F.lit(b"\x01")
    size = F.length("_text")
    folded = texts.where(size > 0).withColumn("_folded", fold(F.col("_text"))).withColumn("_lens", _lengths(names, "_key"))
    cut = lambda at, n: F.substring(F.col("_folded"), at, n)

    def at_place(at: Column) -> Column:
        fits = F.filter("_lens", lambda n: (n <= size - at + 1) & has(0, _slot(cut(at, F.least(n, F.lit(HEAD))))))
        whole = F.filter(fits, lambda n: has(1, _slot(F.concat(cut(at + n - F.least(n, F.lit(TAIL)), F.least(n, F.lit(TAIL))), n.cast("string")))))
        return F.transform(whole, lambda n: cut(at, n))

    places = F.sequence(F.lit(1), size)
    return folded.select("_text", F.explode(F.flatten(F.transform(places, at_place))).alias("_key"))


def _lengths(df: DataFrame, column: str) -> Column:
    """The distinct lengths of a column as one list; a list of lengths stays short."""
    return df.agg(F.sort_array(F.collect_set(F.length(column)))).scalar()


def _endings(df: DataFrame, column: str, lengths: Column) -> DataFrame:
    """Adds ``ending``: one row per ending of the text that has one of the lengths."""
    size = F.length(column)
    cut = F.transform(F.filter("_lens", lambda n: n <= size), lambda n: F.substring(F.col(column), size - n + 1, n))
    return df.withColumn("_lens", lengths).withColumn("ending", F.explode(cut)).drop("_lens")


def fuzzy_match(
    names: DataFrame, candidates: DataFrame, threshold: float = 0.7, min_suffix: int = 1
) -> DataFrame:
    """First candidate, by name, that is like each name; columns name, matched_to.

    Like means: equal without case, one a suffix of the other (so a method name
    without its class fits too), or the words of both overlap by the threshold.
    Candidates are reduced to one per suffix and one per set of words before
    they meet a name, so popular endings and words never multiply rows.
    """
    names = names.select("name").distinct().where(F.length("name") > 0)
    cands = candidates.select(F.col("name").alias("candidate")).distinct().where(F.length("candidate") > 0)

    lower_names = names.select("name", F.lower("name").alias("key"))
    lower_cands = cands.select("candidate", F.lower("candidate").alias("key"))

    by_name = lower_cands.groupBy(F.col("key").alias("ending")).agg(F.min("candidate").alias("candidate"))
    shorter = _endings(lower_names, "key", _lengths(lower_cands, "key")).where(F.length("ending") >= min_suffix).join(
        by_name, "ending"
    ).select("name", "candidate")

    wanted = lower_names.where(F.length("key") >= min_suffix)
    ends = _endings(lower_cands, "key", _lengths(wanted, "key")).join(
        wanted.select(F.col("key").alias("ending")).distinct(), "ending", "left_semi"
    )
    by_ending = ends.groupBy("ending").agg(F.min("candidate").alias("candidate"))
    longer = wanted.join(by_ending, wanted["key"] == by_ending["ending"]).select("name", "candidate")

    alike = similar_words(names, cands, threshold)
    every = shorter.unionByName(longer).unionByName(alike)
    return every.groupBy("name").agg(F.min("candidate").alias("matched_to"))


# counts of words by hash, which order them from rare to common
SKETCH = 1 << 16


def _commonness(words: DataFrame) -> Column:
    """How common the words (column word) of each hash slot are, a byte per slot: the bits of their count."""
    counts = words.groupBy(_slot(F.col("word")).alias("slot")).agg(F.count("*").alias("n"))
    sketch = bytearray(SKETCH)
    for slot, n in counts.collect():  # a row per slot at most, whatever the number of words
        sketch[slot] = n.bit_length()
    return F.lit(bytes(sketch))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SKETCH)).cast("int")


def similar_words(names: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(name, candidate) for the first candidate whose words overlap enough.

    Set similarity join with prefix filtering: words are ordered from rare to
    common, and two sets can only reach the threshold if they share one of
    their first n - ceil(t * n) + 1 words. Equal word sets are joined once.
    Any order both sides share will do, so words are ordered by how common their
    hash slot is, inside the row: no word is shuffled to find its place.
    """
    def word_sets(df: DataFrame, column: str) -> DataFrame:
        return df.select(
            column, F.array_sort(F.array_distinct(T.identifier_tokens(F.col(column)))).alias("words")
        ).where(F.size("words") > 0)

    n_sets = word_sets(names, "name")
    # read twice: for the counts and for the pairs
    c_sets = stage_table(word_sets(candidates, "candidate").groupBy("words").agg(F.min("candidate").alias("candidate")))
    common = _commonness(c_sets.select(F.explode("words").alias("word")))

    def prefix(words: str) -> Column:
        ordered = F.array_sort(F.transform(words, lambda w: F.struct(F.substring(common, _slot(w) + 1, F.lit(1)).alias("n"), w.alias("w"))))
        keep = F.size(words) - F.ceil(F.size(words) * threshold - 1e-9).cast("int") + 1
        return F.explode(F.transform(F.slice(ordered, F.lit(1), keep), lambda r: r["w"])).alias("word")

    left = n_sets.select(F.col("words").alias("a")).distinct().select("a", prefix("a"))
    right = c_sets.select(F.col("words").alias("b"), "candidate", prefix("words"))
    near = (F.size("b") >= F.size("a") * threshold - 1e-9) & (F.size("a") >= F.size("b") * threshold - 1e-9)
    # a pair that shares several of those words is met several times, which the minimum does not mind
    alike = left.join(right, "word").where(near).where(T.jaccard(F.col("a"), F.col("b")) >= threshold)
    named = alike.groupBy("a").agg(F.min("candidate").alias("candidate"))
    return n_sets.join(named, n_sets["words"] == named["a"]).select("name", "candidate")
