"""Queries of problem 1: visually identical text with different characters."""

from pyspark.sql import functions as F

from veilspark.llm.visual import one_form, same_looks
from veilspark.session import load, spread


def p1_found(spark, sf_dir):
    """Pairs of values of one project that differ and look the same."""
    e = load(spark, sf_dir, "entities").select(F.lit("original").alias("field"), F.col("entity_id").alias("key"), "project_id", "kind", F.col("original").alias("t"))
    b = spread(load(spark, sf_dir, "redacted_text_blocks").select(F.lit("text").alias("field"), F.col("block_key").alias("key"), "project_id", F.lit(None).cast("string").alias("kind"), F.col("text").alias("t")))
    values = e.unionByName(b.filter(F.length("t") >= 2))
    pairs = same_looks(values, "key", ["field", "project_id", "kind"], "t", keep="field")
    return pairs.select("field", "key_a", "key_b")


def p1_forms(spark, sf_dir):
    """Every value of either field in one form; a key with several values has a row for each form."""
    e = load(spark, sf_dir, "entities").select(F.lit("original").alias("field"), F.col("entity_id").alias("key"), F.col("original").alias("t"))
    b = spread(load(spark, sf_dir, "redacted_text_blocks").select(F.lit("text").alias("field"), F.col("block_key").alias("key"), F.col("text").alias("t")))
    values = e.unionByName(b).filter("key is not null and t is not null").withColumn("raw", F.unhex(F.md5("t")))
    return one_form(values, ["field", "key", "raw"], "t").select("field", "key", "form").distinct()


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
SQL: dict[str, str] = {}
