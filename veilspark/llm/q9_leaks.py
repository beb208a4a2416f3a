"""Queries of problem 9: evaluation texts inside the corpus."""

from veilspark.llm.leaks import find_leaks
from veilspark.session import load, spread


def p9_found(spark, sf_dir):
    """Pairs of a document and an item of which it holds at least a third as one passage."""
    return find_leaks(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text").select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
