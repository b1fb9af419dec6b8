"""Ground truth tables, and validation of generated text against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators.facts import table_refs
from factloom.operators.joins import contains_join, fuzzy_match, lookup_join
from factloom.session import stage_table


# ground truth -----------------------------------------------------------

def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee) edges."""
    return calls.where((F.col("caller") != "") & (F.col("callee") != "")).select("caller", "callee").distinct()


def first_reference(facts: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The first fact per key, with the number of facts: key, n, columns."""
    picked = facts.where(F.col(key) != "").groupBy(key).agg(
        F.count("*").alias("n"), F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")
    )
    return picked.select(key, "n", *[F.col("_f")[c].alias(c) for c in columns])


def imports_index(imports: DataFrame) -> DataFrame:
    return imports.where((F.col("path") != "") & (F.col("source") != "")).select("path", "source").distinct()


def known_tables(stmts: DataFrame) -> DataFrame:
    """Table names in SQL texts, first word of dotted names only."""
    return table_refs(stmts, [], qualified=False).select("table_name").distinct()


def known_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol names, callees and callers, once each."""
    return (
        symbols.select("name").union(calls.select("callee")).union(calls.select("caller")).distinct()
    )


def truth_index(calls: DataFrame, symbols: DataFrame, udfs: DataFrame) -> DataFrame:
    """One row per known name: where it is first found, by priority
    callee, symbol, UDF (rank 0, 1, 2)."""
    def candidates(df: DataFrame, rank: int, name: str, seq: str, kind: Column) -> DataFrame:
        return df.where(F.col(name) != "").select(
            F.col(name).alias("name"), F.lit(rank).alias("rank"), F.col("path").alias("found_in"), F.col(seq).cast("bigint").alias("seq"), "line", kind.alias("kind"))

    every = candidates(calls, 0, "callee", "edge_seq", F.lit("call")).unionByName(
        candidates(symbols, 1, "name", "seq", F.col("kind"))).unionByName(candidates(udfs, 2, "name", "line", F.lit("udf")))
    # one shuffle: a task sends a row per name
    first = every.groupBy("name").agg(F.min(F.struct("rank", "found_in", "seq", "line", "kind")).alias("_t"))
    return first.select("name", *[F.col("_t")[c].alias(c) for c in ("rank", "found_in", "line", "kind")])


# mentions ---------------------------------------------------------------

def mentions(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct names each text mentions as calls or diagram labels.

    A row is one text, so the names are made distinct inside the row.
    """
    body = F.col(text)
    message, label, call = V.MENTION_PATTERNS
    plain = F.filter(
        T.find_all(body, call), lambda n: (F.length(n) > 3) & ~T.is_upper(F.left(n, F.lit(1)))
    )
    names = F.array_distinct(F.concat(T.find_all(body, message), T.find_all(body, label), plain))
    return texts.select(*keys, F.explode(names).alias("name"))


def table_mentions(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    names = F.array_distinct(T.find_all(F.col(text), V.TABLE_MENTION))
    found = texts.select(*keys, F.explode(names).alias("table_name"))
    return found.where(~F.lower("table_name").isin(*V.TABLE_STOP_STATEMENT))


def validate_tables(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds status: a semi and an anti join in one pass over the mentions.

    ``known`` has one row per table name.
    """
    marked = lookup_join(found, known.select("table_name", F.lit(True).alias("_known")), "table_name", "left")
    return marked.select(
        *found.columns, F.when(F.col("_known"), F.lit("verified")).otherwise(F.lit("unverified")).alias("status")
    )


def validate_calls(found: DataFrame, index: DataFrame) -> DataFrame:
    """Looks every mention up in the truth index; misses are unverified."""
    marked = lookup_join(found, index, "name", "left")
    return marked.select(
        *found.columns,
        F.when(F.col("rank").isNull(), F.lit("unverified")).otherwise(F.lit("verified")).alias("status"),
        F.when(F.col("rank").isNotNull(), F.lit("exact")).otherwise(F.lit("")).alias("match_type"),
        F.coalesce("found_in", F.lit("")).alias("found_in"), F.coalesce("line", F.lit(0)).alias("line"),
        F.coalesce("kind", F.lit("")).alias("kind"),
    )


def rescue(validated: DataFrame, known: DataFrame, threshold: float = V.FUZZY_THRESHOLD, min_suffix: int = 1) -> DataFrame:
    """Second chance for unverified names: the first known name like them."""
    # both name lists meet in several joins, so they are computed once
    misses = stage_table(validated.where(F.col("status") == "unverified").select("name").distinct())
    likes = fuzzy_match(misses, stage_table(known), threshold, min_suffix)
    joined = lookup_join(validated, likes, "name", "left")
    saved = (F.col("status") == "unverified") & F.col("matched_to").isNotNull()
    return joined.select(
        *[c for c in validated.columns if c not in ("status", "match_type")],
        F.when(saved, F.lit("verified")).otherwise(F.col("status")).alias("status"),
        F.when(saved, F.lit("fuzzy")).otherwise(F.col("match_type")).alias("match_type"),
        F.when(saved, F.col("matched_to")).otherwise(F.lit("")).alias("matched_to"),
    )


def accuracy(validated: DataFrame, keys: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Verified share per text; 1.0 for texts of ``texts`` without a mention."""
    scored = validated.groupBy(*keys).agg(
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
    )
    if texts is not None:
        scored = texts.select(*keys).distinct().join(scored, keys, "left").na.fill(0, ["verified", "unverified"])
    total = F.col("verified") + F.col("unverified")
    return scored.withColumn("accuracy", F.when(total == 0, F.lit(1.0)).otherwise(F.col("verified") / total))


def udfs_in_text(texts: DataFrame, keys: list[str], udfs: DataFrame, text: str = "text") -> DataFrame:
    """UDF names that occur in a text, anywhere in a word and in any case.

    A UDF name is made of word characters, so it lies inside one word of the
    text: names are searched in the distinct words, then words are traced back.
    """
    words = F.array_distinct(T.find_all(F.lower(F.col(text)), r"\w+", 0))
    spread = texts.select(*keys, F.explode(words).alias("word"))
    hits = contains_join(spread.select("word"), "word", udfs.select("name").distinct(), "name")
    return lookup_join(spread, hits, "word").select(*keys, "name").distinct()


def unknown_udf_mentions(texts: DataFrame, keys: list[str], udfs: DataFrame, text: str = "text") -> DataFrame:
    """udf_x mentions without a registered x; repeats are kept."""
    found = texts.select(*keys, F.posexplode(T.find_all(F.col(text), V.UDF_MENTION)).alias("seq", "name"))
    known = udfs.select("name", F.lit(True).alias("_known")).distinct()
    return lookup_join(found, known, "name", "left").where(F.col("_known").isNull()).select(*keys, "seq", "name")


def missing_calls(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Callees of the call graph that no text mentions."""
    return edges.select("callee").distinct().join(
        found.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti"
    )
