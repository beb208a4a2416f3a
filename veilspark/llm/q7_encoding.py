"""Queries of problem 7: text garbled by a wrong encoding."""

from veilspark.llm.mojibake import repair_columns
from veilspark.session import load, spread

_FIELDS = ["text", "source_file"]


def p7_found(spark, sf_dir):
    """Each block and field that holds garbled text."""
    b = spread(load(spark, sf_dir, "redacted_text_blocks").select("block_key", *_FIELDS))
    return repair_columns(b, "block_key", _FIELDS, restore=False).select("block_key", "field").distinct()


def p7_restored(spark, sf_dir):
    """The garbled fields with their text as far as it can be restored."""
    b = spread(load(spark, sf_dir, "redacted_text_blocks").select("block_key", *_FIELDS))
    return repair_columns(b, "block_key", _FIELDS).distinct()


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
SQL: dict[str, str] = {}
