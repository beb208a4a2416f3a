"""Queries of problem 6: personal information inside free text."""

from veilspark.llm.personal import find_personal, redact
from veilspark.session import load, spread


def _inputs(spark, sf_dir):
    return spread(load(spark, sf_dir, "redacted_text_blocks").select("block_key", "text")), load(spark, sf_dir, "entities")


def p6_found(spark, sf_dir):
    """Each block and kind of personal data that still stands in its text."""
    b, e = _inputs(spark, sf_dir)
    return find_personal(b, "block_key", "text", e)


def p6_redacted(spark, sf_dir):
    """The blocks with personal data, with typed placeholders in its place."""
    b, e = _inputs(spark, sf_dir)
    return redact(b, "block_key", "text", e)


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
SQL: dict[str, str] = {}
