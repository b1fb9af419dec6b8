"""Prompts over all modules hold every fact, and their texts reach the report."""

from pyspark.sql import functions as F

from factloom.plans import reports as R


def test_every_line_is_in_a_part(spark):
    analyses = spark.createDataFrame([(f"m{i:03d}", f"## Core flow\nmodule {i}") for i in range(40)], "module string, markdown string")
    calls = spark.createDataFrame(
        [(f"f{i}.c", i, "run", f"callee_{i}", "direct", i + 1) for i in range(400)],
        "path string, edge_seq bigint, caller string, callee string, edge_type string, line int",
    )
    none = R._lines(analyses.where("false"), 1, 0, 0, F.col("module"), F.col("markdown"))
    whole = R.flow_prompts(calls, none, analyses).collect()
    assert [r.module for r in whole] == ["flows"]
    parts = R.part_texts(R.flow_prompts(calls, none, analyses, part_chars=1000).withColumn("text", F.col("user"))).orderBy("part").collect()
    head = "Describe the flows that cross modules, from these facts.\n\n"
    assert len(parts) > 9 and all(r.text.startswith(head) and len(r.text) < 1200 for r in parts)
    assert "".join(r.text[len(head) :] for r in parts) == whole[0].user[len(head) :]
    long = R.flow_prompts(calls.withColumn("callee", F.concat("callee", F.lit("x" * 500))), none, analyses).collect()
    assert len(long) > 1 and sum(r.user.count("→") for r in long) == 400


def test_all_parts_reach_the_report(spark):
    analyses = spark.createDataFrame([("m", "## A\nb")], "module string, markdown string")
    flows = spark.createDataFrame([(f"flows_part{i}", f"text {i}\nend") for i in (10, 2, 1)], "module string, text string")
    lines = R.final_document(analyses, "T", "Layers.", R.part_texts(flows)).orderBy(*R.KEYS)
    text = "\n".join(r.line for r in lines.collect())
    assert "## 2. Flows across modules\n\ntext 1\nend\ntext 2\nend\ntext 10\nend\n\n---" in text
