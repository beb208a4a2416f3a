"""Queries of problem 4: one postal address written differently."""

from pyspark.sql import functions as F

from veilspark.llm.addresses import readings, same_places
from veilspark.session import load


def p4_found(spark, sf_dir):
    """Pairs of address records, of any projects, that denote one place."""
    e = load(spark, sf_dir, "entities").filter("kind = 'address'")
    return same_places(e, "entity_id", "original").select(F.col("key_a").alias("entity_a"), F.col("key_b").alias("entity_b"))


def p4_readings(spark, sf_dir):
    """The parts of every address record."""
    return readings(load(spark, sf_dir, "entities").filter("kind = 'address'"), "entity_id", "original").distinct()


QUERIES = {"p4_found": p4_found, "p4_readings": p4_readings}
SQL: dict[str, str] = {}
