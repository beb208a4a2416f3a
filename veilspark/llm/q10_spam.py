"""Queries of problem 10: keyword-stuffed and link-list pages."""

from veilspark.llm.spam import find_spam
from veilspark.session import load, spread


def p10_found(spark, sf_dir):
    """Documents that are mainly keywords, links or product rows."""
    return find_spam(spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "doc_id", "text", "lang").filter("spam").select("doc_id").distinct()


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
