"""Categories of built-in SQL functions.

The default table follows a rule: every function registered in the running
Spark, under the category its documentation group belongs to. A caller with a
table of their own (name, category, category_rank) passes that instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATEGORIES = [
    "aggregate", "window", "string", "math", "datetime", "collection", "cast", "conditional", "misc",
]
GROUP_CATEGORY = {
    "agg_funcs": "aggregate", "window_funcs": "window", "string_funcs": "string", "url_funcs": "string",
    "math_funcs": "math", "bitwise_funcs": "math", "datetime_funcs": "datetime",
    "array_funcs": "collection", "collection_funcs": "collection", "map_funcs": "collection",
    "struct_funcs": "collection", "lambda_funcs": "collection", "generator_funcs": "collection",
    "json_funcs": "collection", "csv_funcs": "collection", "xml_funcs": "collection",
    "variant_funcs": "collection", "conversion_funcs": "cast", "conditional_funcs": "conditional",
    "predicate_funcs": "conditional", "hash_funcs": "misc", "misc_funcs": "misc",
}


def function_table(spark: SparkSession) -> DataFrame:
    """(name, category, category_rank) for the functions of this Spark."""
    infos = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()
    rows = sorted(
        (i.getName(), GROUP_CATEGORY[i.getGroup()])
        for i in infos
        if i.getGroup() in GROUP_CATEGORY and i.getName().replace("_", "").isalnum()
    )
    ranked = [(n, c, CATEGORIES.index(c) + 1) for n, c in rows]
    return spark.createDataFrame(ranked, "name string, category string, category_rank int")


def categorize(calls: DataFrame, table: DataFrame, name: str = "name") -> DataFrame:
    """Adds is_builtin and category; the first category wins, misses are unknown.

    The table may be the caller's own, so Spark measures it before it broadcasts it.
    """
    one = table.groupBy(F.lower("name").alias("_fn")).agg(
        F.min_by("category", "category_rank").alias("_category")
    )
    joined = calls.join(one, F.lower(F.col(name)) == F.col("_fn"), "left")
    return joined.withColumn("is_builtin", F.col("_fn").isNotNull()).withColumn(
        "category", F.coalesce("_category", F.lit("unknown"))
    ).drop("_fn", "_category")
