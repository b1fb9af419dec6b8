"""Code and report corpora that Spark derives from the given tables.

The given tables hold prose and web pages, not code. Each corpus writes one
source file per row of a table, so operators on code run over data that grows
with the tables, and what they must find follows from the row's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions import text as T
from factloom.session import FILES_PER_TASK, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(template: str, **values: Column) -> Column:
    """Template with {name} holes filled from columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append({"(": F.lit("{"), ")": F.lit("}")}.get(name, values.get(name)))
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)


def _files(df: DataFrame, key: str, path: Column, content: Column, language: str) -> DataFrame:
    return df.select(
        F.col(key).alias("file_seq"), path.alias("path"), T.module_of(path).alias("module"),
        F.lit(language).alias("language"), content.alias("content"),
    )


C_FILE = """#include <stdio.h>
#include "brand_{b}.h"

struct ops_{s} {(}
    int size;
    int (*on_{t})(int code, char *msg);
    void (*handler)(void *ctx);
{)};

static int run_{k}(struct ops_{s} *p, int n)
{(}
    p->on_{t} = handle_{b};
    p->handler = cb_{b};
    p->limit = 10;
    p->fallback = NULL;
    p->handler(n);
    return helper_{s}(n, "quoted {(} brace");
{)}
"""


def c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand"), FILES_PER_TASK)
    v = {
        "k": F.col("p_partkey").cast("string"), "t": F.lower("p_type"), "s": F.col("p_size").cast("string"),
        "b": F.replace("p_brand", F.lit("Brand#"), F.lit("")),
    }
    return _files(part, "p_partkey", _text("src/{t}/part_{k}.c", **v), _text(C_FILE, **v), "C")


JAVA_FILE = """package com.acme;
import java.util.List;
import static com.acme.Util.log;

public class Customer{k} extends Base{n} implements Audit{n}, Scored {(}
    private int score = {n};
    public static int rate(int base, String label, double w) {(}
        log.info("rate(x)");
        return helper{n}(base);
    {)}
    protected abstract void audit();
{)}
"""


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), FILES_PER_TASK)
    v = {
        "k": F.col("c_custkey").cast("string"), "n": F.col("c_nationkey").cast("string"), "g": F.lower("c_mktsegment"),
    }
    return _files(customer, "c_custkey", _text("java/{g}/Customer{k}.java", **v), _text(JAVA_FILE, **v), "Java")


SCALA_FILE = """package jobs
import org.apache.spark.sql.SparkSession

object Job{k} extends App {(}
  def run(spark: SparkSession): Unit = {(}
    spark.udf.register("udf_{n}", clean)
    val cfg = XMLLoader.load("conf/{g}.xml")
    val df = spark.sql("SELECT c_custkey, my_udf(c_name) FROM crm.cust_{n} WHERE c_acctbal > 0")
    df.write.parquet("/out/cust_{k}")
    df.write.saveAsTable("mart.cust_{n}")
    val again = XMLLoader.load("conf/{g}.xml")
  {)}
  def twice(a: Int) = plus(a)
{)}
"""


def scala_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), FILES_PER_TASK)
    v = {
        "k": F.col("c_custkey").cast("string"), "n": F.col("c_nationkey").cast("string"), "g": F.lower("c_mktsegment"),
    }
    return _files(customer, "c_custkey", _text("scala/{g}/Job{k}.scala", **v), _text(SCALA_FILE, **v), "Scala")


PYTHON_FILE = '''import os, json
from app.core import load, save as store

LIMIT = {c}
_cache = {(}{)}

def run_{k}(src: str, n=10) -> int:
    """Load order {k}."""
    data = load(src)
    sql = "INSERT OVERWRITE TABLE dw.orders_{s} SELECT * FROM raw.orders_{s}"
    with open("out/order_{k}.csv", "w") as f:
        f.write(data)
    bus.send("topic_{s}")
    return store(data)

class Job{k}(Base):
    def source_rows(self, spark):
        return spark.table("t").count()

if __name__ == "__main__":
    run_{k}("in")
'''


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), FILES_PER_TASK)
    v = {
        "k": F.col("o_orderkey").cast("string"), "s": F.lower("o_orderstatus"), "c": F.col("o_custkey").cast("string"),
    }
    return _files(orders, "o_orderkey", _text("py/{s}/order_{k}.py", **v), _text(PYTHON_FILE, **v), "Python")


SQL_FILE = """-- order {k}; report
CREATE TABLE IF NOT EXISTS mart.ord_{k} AS
SELECT upper(o_comment), my_fn(o_key), sum(left(x, 2)) FROM db.orders_{s} o JOIN `cust` c ON o.k = c.k;

WITH t1 AS (SELECT 1 FROM base_{s}), t2 AS (SELECT 2 FROM t1) SELECT * FROM t2;
INSERT INTO TABLE log_{s} VALUES ('a;b', now());
DELETE FROM old_{s} WHERE id = {k}
"""


def sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), FILES_PER_TASK)
    v = {"k": F.col("o_orderkey").cast("string"), "s": F.lower("o_orderstatus")}
    return _files(orders, "o_orderkey", _text("sql/{s}/o_{k}.sql", **v), _text(SQL_FILE, **v), "SQL")


XML_FILE = """<?xml version="1.0"?>
<pipeline name="p{k}" owner="n{n}">
  <step id="1">
    SELECT upper(s_name), rank_{n}(s_acctbal)
    FROM ext.supp_{n} WHERE s_acctbal > 0
  </step>
  <note>SELECT 1</note>
  <sink/>
</pipeline>
"""


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), FILES_PER_TASK)
    v = {"k": F.col("s_suppkey").cast("string"), "n": F.col("s_nationkey").cast("string")}
    return _files(supplier, "s_suppkey", _text("conf/nation_{n}/pipe_{k}.xml", **v), _text(XML_FILE, **v), "XML")


ANALYSIS = """sequenceDiagram
    A->>B: run_{k}(x)
    X["call load"]
It uses helper_{c}(a) and Job{k}() then core.load(b) and store(data).
SELECT * FROM raw JOIN ghost_{s}; udf_{n} and UDF_99 are used.
"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text about each Python file, as a text generator would write it."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), FILES_PER_TASK)
    v = {
        "k": F.col("o_orderkey").cast("string"), "s": F.lower("o_orderstatus"), "c": F.col("o_custkey").cast("string"),
        "n": (F.col("o_custkey") % 30).cast("string"),
    }
    return orders.select(F.col("o_orderkey").alias("doc"), _text(ANALYSIS, **v).alias("text"))


REPORT = """# Doc {k}

##{e}
## Dropped parent
### Core Flow
{text}
```mermaid
flowchart TD
    A{k}[call(x)] --> B["a = b"]
    B --> C["end"]
# no heading
```
### Notes {k}
- one **b{k}**
- two

1. `x` < 2

| a | b |
|---|---|
| {k} | <i> |

---
## Empty end
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report per document, with the document's text in it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    v = {"k": F.col("doc_id").cast("string"), "text": F.col("text"), "e": F.lit(" ")}
    return docs.select(F.col("doc_id").alias("doc"), "source", _text(REPORT, **v).alias("markdown"))


def part_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report with a part's name as text."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), FILES_PER_TASK)
    v = {"k": F.col("p_partkey").cast("string"), "text": F.col("p_name"), "e": F.lit(" ")}
    return part.select(F.col("p_partkey").alias("doc"), _text(REPORT, **v).alias("markdown"))


MODULE_TEXT = """# Module {k}
It holds {name}.
## Duty
Keeps {k}.
## Core flow
```mermaid
flowchart TD
    A[go(x)] --> B
```
"""


def module_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated analysis per part, as if each part were a module."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), FILES_PER_TASK)
    v = {"k": F.col("p_partkey").cast("string"), "name": F.col("p_name")}
    return part.select(_text("src_part_{k}", **v).alias("module"), _text(MODULE_TEXT, **v).alias("markdown"))


DIAGRAM = """Intro {k}
```mermaid
sequenceDiagram
    alt size {k}
    A->>B: set x = "v{k}"
    B-->>A: a;b;c
    loop every {k}
    A->>B: go
    end
```
Then
```mermaid
flowchart LR
    subgraph "Part {k}"
    P{k}{(}size = "big"{)} -->|calls f(x)| Q[load(x)]
    Q ---ox
    end
```
"""


def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand"), FILES_PER_TASK)
    v = {"k": F.col("p_partkey").cast("string")}
    return part.select(F.col("p_partkey").alias("doc"), _text(DIAGRAM, **v).alias("markdown"))


def stream_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat response bodies: an event stream on odd rows, plain JSON on even ones."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), FILES_PER_TASK)
    k = F.col("o_orderkey").cast("string")
    chunk = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices")))
    stream = F.concat(
        F.lit("data: "), chunk(F.concat(F.lit("Order "), k)), F.lit("\n\ndata: "), chunk(F.lit(" is ")),
        F.lit("\ndata: not json\n: note\ndata: "), chunk(F.col("o_orderstatus")), F.lit("\ndata: [DONE]\n"),
    )
    message = F.struct(F.lit("").alias("content"), F.concat(F.lit("Thought "), k).alias("reasoning_content"))
    plain = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return orders.select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 1, stream).otherwise(plain).alias("body"))
