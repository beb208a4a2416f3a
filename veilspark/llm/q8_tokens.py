"""Queries of problem 8: token ids of the corpus."""

from veilspark.llm.tokens import encode
from veilspark.session import load, spread


def p8_ids(spark, sf_dir):
    """Every document once, with its ids by byte_bpe_50k; null and empty texts have an empty list."""
    return encode(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
