"""Versions of stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir, stage_table, staging
from factloom.sources import versions as W


def test_publish_and_read(spark, tmp_path):
    out = str(tmp_path)
    assert W.current(spark, out, "t") is None
    with pytest.raises(FileNotFoundError):
        W.read(spark, out, "t")
    first = W.publish(spark.range(3), out, "t")
    second = W.publish(first.select((F.col("id") + 10).alias("id")), out, "t")  # reads the version it supersedes
    assert [r.id for r in W.read(spark, out, "t").orderBy("id").collect()] == [10, 11, 12]
    assert first.count() == 3 and second.count() == 3
    parted = W.publish(spark.range(4).withColumn("p", F.col("id") % 2), out, "u", "p")
    assert parted.where("p = 1").count() == 2


def test_failed_write_loses_nothing(spark, tmp_path):
    out = str(tmp_path)
    W.publish(spark.range(3), out, "t")
    with pytest.raises(Exception, match="broken"):
        W.publish(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), out, "t")
    assert W.read(spark, out, "t").count() == 3
    assert len(W.clean(spark, out, 0)) == 1  # what the failed write left
    assert W.read(spark, out, "t").count() == 3


def test_clean_by_age(spark, tmp_path):
    out = str(tmp_path)
    for n in range(3):
        W.publish(spark.range(n), out, "t")
    assert W.clean(spark, out, 3600) == []
    assert len(W.clean(spark, "file:" + out, 0)) == 2
    assert W.read(spark, out, "t").count() == 2 and len(os.listdir(tmp_path / "t")) == 1


def test_staging_leaves_nothing(spark):
    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(folder))
    with staging(spark):
        assert stage_table(spark.range(3)).count() == 3
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
