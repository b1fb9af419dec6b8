"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+``. All measures come from one expression per row:
arrays that several measures use are bound once (``let``), and words in repeated
windows are found by sorting the window hashes of a text only if two are equal.

Null text counts as empty: no words, so it fails the base rule. Null doc_id and
repeated rows are kept as they are. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import let, prepare, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# frequent words of the languages in the corpus
STOP_WORDS = (
    "the of and to in is was for that with on as are by this from have you not it an at be or "
    "der die das und ist von mit den im des ein eine auf für zu dem nicht sich "
    "le la les de des et en un une du est pour dans que qui sur par pas "
    "el los las y en que un una del por con para es al se su"
).split()

# (measure, lower bound or None, upper bound or None) of the method's verdict: a
# row is kept if each measure lies within its bounds
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("word_length", 1.5, 15.0),
    ("symbol_ratio", None, 0.1),
    ("shout_ratio", None, 0.3),
    ("stop_word_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    def covered(grams: Column) -> Column:
        def marked(order: Column) -> Column:
            same = F.filter(order, lambda x, i: ((i > 0) & (order[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | (F.get(order, i + 1)["h"] == x["h"]).eqNullSafe(True))
            return let(F.array_sort(F.transform(same, lambda x: x["i"])), lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        some = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(some, let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)).otherwise(0)

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))), covered)

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(0)


def _measures(text: Column, thresholds) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            # the symbols are ASCII: a byte each
            sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
            _repeat_words(words).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("stops"),
            ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).alias("shouts"),
        )

    def judged(c: Column) -> Column:
        n = F.greatest(c["n_words"], F.lit(1))
        measures = {
            "word_length": c["word_chars"] / n, "symbol_ratio": c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1)), "shout_ratio": c["shouts"] / n,
            "stop_word_ratio": c["stops"] / n, "dup_line_ratio": c["lines"]["dup"] / F.greatest(c["lines"]["n"], F.lit(1)),
        }
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["lines"]["dup"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), (~failed & compile_rules(measures, thresholds)).alias("kept"),
            *(m.alias(name) for name, m in measures.items()),
        )

    return let(let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words), judged)


def compile_rules(measures: dict[str, Column], thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    kept = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            kept = kept & (measures[name] >= low)
        if high is not None:
            kept = kept & (measures[name] <= high)
    return kept


def _judged(docs: DataFrame, thresholds) -> DataFrame:
    """The rows as one struct ``_row`` beside their measures, so that no name can clash."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), text_or_empty().alias("_text"))
    return rows.select("_row", _measures(F.col("_text"), thresholds).alias("_rules"))


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row; a single narrow projection."""
    return _judged(docs, thresholds).select("_row.doc_id", "_rules.*")


def keep_by_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows that are kept, with their own columns."""
    return _judged(docs, thresholds).filter("_rules.kept").select("_row.*")
