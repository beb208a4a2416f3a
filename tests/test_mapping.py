from veilspark.functions.numbering import number_within
from veilspark.operators import mapping

ENTITY = "project_id string, ord int, kind string, original string, placeholder_prefix string, strategy string, replacement_hint string"
DECISION = "project_id string, candidate_id string, action string, strategy string"


def cid(kind, original):
    import hashlib

    return hashlib.sha256(f"{kind}|{original}".encode()).hexdigest()[:16]


def test_build_mapping(spark):
    e = spark.createDataFrame(
        [("p", 1, "person", "甲", "人员", "pseudonym", None), ("p", 2, "person", "乙", "人员", "pseudonym", None), ("p", 3, "amount", "5万元", "金额区间", "range", "低于10万"), ("p", 4, "technical_metric", "5kV", "技术指标", "keep", None), ("p", 5, "technical_metric", "6kV", "技术指标", "keep", None), ("p", 6, "phone", None, "电话", "mask", None), ("q", 1, "person", "甲", "人员", "pseudonym", None)],
        ENTITY,
    )
    d = spark.createDataFrame([("p", cid("person", "甲"), "keep", None), ("p", cid("technical_metric", "5kV"), "redact", "keep"), ("p", cid("technical_metric", "6kV"), "redact", "nonsense"), ("p", "unknown", "drop", None)], DECISION)
    got = {(r["project_id"], r["original"]): (r["placeholder"], r["replacement"], r["strategy"]) for r in mapping.build_mapping(e, d).collect()}
    assert got == {("p", "乙"): ("人员A", "人员A", "pseudonym"), ("p", "5万元"): ("金额区间A", "金额区间A（低于10万）", "range"), ("p", "5kV"): ("技术指标A", "技术指标A", "keep"), ("p", "6kV"): ("技术指标B", "技术指标B", "mask"), ("q", "甲"): ("人员A", "人员A", "pseudonym")}


def test_merge_goes_on_from_the_count_and_skips_used_letters(spark):
    fields = "project_id string, ord int, candidate_id string, kind string, original string, placeholder string, replacement string, strategy string, default_strategy string, preservation_value string"
    old = spark.createDataFrame([("p", 1, cid("person", "甲"), "person", "甲", "人员A", "人员A", "pseudonym", "pseudonym", None), ("p", 2, cid("person", "乙"), "person", "乙", "人员C", "人员C", "pseudonym", "pseudonym", None)], fields)
    new = spark.createDataFrame([("p", 1, "person", "甲", "人员", "pseudonym", None), ("p", 2, "person", "丙", "人员", "pseudonym", None), ("p", 3, "person", "丁", "人员", "pseudonym", None)], ENTITY)
    got = {r["original"]: r["placeholder"] for r in mapping.merge_mapping(old, new, spark.createDataFrame([], DECISION)).filter("added").collect()}
    assert got == {"丙": "人员D", "丁": "人员E"}


def test_number_within_matches_a_plain_count(spark):
    import random

    random.seed(1)
    rows = [("hot" if random.random() < 0.6 else f"g{random.randrange(5)}", i) for i in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int").repartition(7)
    got = number_within(df, ["g"], ["o"], "n").collect()
    for g in {r["g"] for r in got}:
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(1, sum(r["g"] == g for r in got) + 1))


def test_hash_is_of_sorted_json():
    import hashlib
    import json

    items = [{"b": None, "a": "值"}]
    assert mapping.mapping_hash(items) == hashlib.sha256(json.dumps(items, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
