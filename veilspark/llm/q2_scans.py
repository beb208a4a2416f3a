"""Queries of problem 2: noise in text from scanned pages."""

from veilspark.llm.scans import find_noise, repair
from veilspark.session import load, spread


def p2_found(spark, sf_dir):
    """Blocks with a cut word, misread characters, a running header or a page number."""
    b = spread(load(spark, sf_dir, "redacted_text_blocks").select("block_key", "text"))
    return find_noise(b, "block_key", "text").select("block_key").distinct()


def p2_repaired(spark, sf_dir):
    """Every block's text as continuous paragraphs."""
    return repair(load(spark, sf_dir, "redacted_text_blocks"), "block_key", "text")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
