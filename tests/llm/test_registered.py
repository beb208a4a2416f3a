"""Every text query runs on the smallest tables and has the columns that are asked for."""

import pytest

from veilspark.llm import registry

COLUMNS = {
    "p1_found": ["field", "key_a", "key_b"], "p2_found": ["block_key"], "p4_found": ["entity_a", "entity_b"], "p5_found": ["entity_a", "entity_b"], "p6_found": ["block_key", "kind"],
    "p7_found": ["block_key", "field"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len({repr(r) for r in rows})


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(COLUMNS) | {"p3_found"} <= set(e.queries())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).parents[2] / "veilspark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "veilspark.llm" in p.read_text(encoding="utf-8")]
