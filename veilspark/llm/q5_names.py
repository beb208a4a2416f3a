"""Queries of problem 5: variant spellings of persons and organisations."""

from pyspark.sql import functions as F

from veilspark.llm.names import same_names
from veilspark.session import load


def p5_found(spark, sf_dir):
    """Pairs of entities of one project and kind that mean the same person or organisation."""
    e = load(spark, sf_dir, "entities")
    out = None
    for kind in ("person", "organization"):
        one = same_names(e.filter(F.col("kind") == kind), "entity_id", ["project_id"], "original", kind)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("key_a").alias("entity_a"), F.col("key_b").alias("entity_b"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
