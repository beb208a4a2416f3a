import random

import pytest

from veilspark.operators.redact import Replacer, apply_spans, claim_spans, present_values, redact, redact_cells, redact_runs

ITEM = "project_id string, ord int, original string, replacement string, placeholder string"


def naive(text, pairs):
    """The definition, written out: longest first, left to right, on behind each hit even if it was claimed."""
    taken, spans = [], []
    for o, n in sorted(dict.fromkeys(p for p in pairs if p[0]), key=lambda p: -len(p[0])):
        at = text.find(o)
        while at >= 0:
            if all(at + len(o) <= a or at >= b for a, b in taken):
                taken.append((at, at + len(o)))
                spans.append((at, at + len(o), n))
            at = text.find(o, at + len(o))
    return apply_spans(text, sorted(spans))


def test_random_texts_match_the_definition():
    random.seed(7)
    for _ in range(400):
        pairs = list({"".join(random.choice("ab甲😀") for _ in range(random.randrange(1, 4))): f"<{i}>" for i in range(5)}.items())
        text = "".join(random.choice("ab甲😀c") for _ in range(30))
        assert Replacer(pairs)(text) == naive(text, pairs)


@pytest.mark.parametrize(
    "text,pairs,want",
    [("北京大学与北京", [("北京", "单位A"), ("北京大学", "单位B")], "单位B与单位A"), ("AB", [("A", "B"), ("B", "C")], "BC"), ("aaa", [("aa", "x")], "xa"), ("", [("a", "b")], ""), ("abc", [], "abc"), ("a.c", [("a.c", "\\E")], "\\E")],
)
def test_cases(text, pairs, want):
    assert Replacer(pairs)(text) == want
    assert apply_spans(text, claim_spans(text, sorted(pairs, key=lambda p: -len(p[0])))) == want


def test_each_text_meets_its_own_project(spark):
    t = spark.createDataFrame([("p", 1, "甲与乙", "x"), ("q", 2, "甲与乙", "x"), ("p", 3, None, "x"), ("r", 4, "甲", "x")], "project_id string, k int, text string, original string")
    i = spark.createDataFrame([("p", 1, "甲", "人员A", "人员A"), ("q", 1, "乙", "人员A", "人员A"), ("q", 2, None, "x", "x")], ITEM)
    got = {r["k"]: r["text"] for r in redact(t, i, "project_id", "k", "text").collect()}
    assert got == {1: "人员A与乙", 2: "甲与人员A", 3: None, 4: "甲"}
    back = redact(spark.createDataFrame([("p", 1, "人员A（低）与人员A")], "project_id string, k int, text string"), spark.createDataFrame([("p", 1, "甲", "人员A（低）", "人员A")], ITEM), "project_id", "k", "text", restore=True)
    assert back.first()["text"] == "甲与甲"


def test_a_hot_project_with_values_of_all_lengths(spark, monkeypatch):
    """Against replacing by brute force, with a bitmap of few slots, so that most grams pass it."""
    import random

    import veilspark.operators.redact as r

    monkeypatch.setattr(r, "MOST_SLOT_BITS", 16)
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("甲乙丙丁ab1") for _ in range(n))
    values = {p: sorted({word(rnd.randrange(1, 9)) for _ in range(60)} | {"甲"}) for p in ("p", "q", None)}
    items = [(p, i, v, f"<{i}>", f"<{i}>") for p, vs in values.items() for i, v in enumerate(vs)]
    texts = [(rnd.choice(["p", "p", "p", "q", "none", None]), i, word(rnd.randrange(0, 60))) for i in range(300)] + [("p", 300, None), ("p", 0, None)]
    t = spark.createDataFrame(texts, "project_id string, k int, text string")
    got = r.redact(t, spark.createDataFrame(items, ITEM), "project_id", "k", "text").collect()
    want = [(p, k, x if x is None else Replacer([(v, n) for q, _, v, _, n in items if q == p])(x)) for p, k, x in texts]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def shuffled(spark) -> int:
    """Bytes that all tasks so far have written for a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(i) for i in range(s.size())])(sc.statusStore().executorList(False)))


def test_values_travel_once_and_texts_without_hits_send_none(spark):
    """20,000 values of 12 characters are 240 kB; no shuffle holds the grams of values, or grams of texts that pass the screen by chance."""
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    items = spark.createDataFrame([("p", i, word(12), f"<{i}>", f"<{i}>") for i in range(20_000)], ITEM)
    texts = [("p", i, word(500)) for i in range(300)]
    began = shuffled(spark)
    got = redact(spark.createDataFrame(texts, "project_id string, k int, text string"), items, "project_id", "k", "text").collect()
    assert sorted(map(tuple, got)) == sorted(texts)
    assert shuffled(spark) - began < 3_500_000


def many_values(spark):
    """20,000 values of a project as items, and a maker of random words."""
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    return spark.createDataFrame([("p", i, word(12), f"<{i}>", f"<{i}>") for i in range(20_000)], ITEM), word


def test_cells_without_hits_send_none(spark):
    items, word = many_values(spark)
    rows = [("p", i, ([(f"A{i}", word(100)), (f"B{i}", None)],)) for i in range(500)]
    blocks = spark.createDataFrame(rows, "project_id string, k int, structure struct<cells: array<struct<ref: string, text: string>>>")
    began = shuffled(spark)
    got = {r["k"]: [tuple(c) for c in r["cells"]] for r in redact_cells(blocks, items, "project_id", "k").collect()}
    assert got == {k: cells for _, k, (cells,) in rows}
    assert shuffled(spark) - began < 3_500_000


def test_cells_of_distinct_blocks_are_made_distinct_once(spark):
    """2 MB of cells behind an exchange of their blocks, which goes over the wire once."""
    word = many_values(spark)[1]
    rows = [("p", i, ([(f"A{i}", word(1000))],)) for i in range(2000)]
    blocks = spark.createDataFrame(rows, "project_id string, k int, structure struct<cells: array<struct<ref: string, text: string>>>")
    began = shuffled(spark)
    got = redact_cells(blocks.dropDuplicates(["k"]), spark.createDataFrame([("p", 1, "甲", "人员A", "人员A")], ITEM), "project_id", "k").collect()
    assert {r["k"]: [tuple(c) for c in r["cells"]] for r in got} == {k: cells for _, k, (cells,) in rows}
    assert shuffled(spark) - began < 7_000_000


def test_blocks_travel_once_and_count_once(spark):
    """2 MB of cells in blocks that stand twice, of which one holds a value: they are exchanged to be made distinct, and for nothing else."""
    word = many_values(spark)[1]
    rows = [("p", i, ([(f"A{i}", word(1000)), (f"B{i}", None)],)) for i in range(2000)] + [("p", 2000, ([("A", "与甲乙"), None, ("B", "甲")],)), ("p", 2001, ([],)), ("p", 2002, None)]
    kind = "project_id string, k int, structure struct<cells: array<struct<ref: string, text: string>>>"
    items = spark.createDataFrame([("p", 1, "甲乙", "人员A", "人员A"), ("p", 2, "乙甲", "人员B", "人员B")], ITEM)
    began = shuffled(spark)
    got = redact_cells(spark.createDataFrame(rows + rows[-1000:], kind), items, "project_id", "k").collect()
    want = {k: s[0] for _, k, s in rows[:2000]} | {2000: [("A", "与人员A"), (None, None), ("B", "甲")]}
    assert sorted((r["k"], [tuple(c) for c in r["cells"]]) for r in got) == sorted(want.items())
    assert shuffled(spark) - began < 3_500_000


def test_contains_join_sends_values_once(spark):
    items, word = many_values(spark)
    texts = spark.createDataFrame([("p", word(500)) for _ in range(300)], "project_id string, text string")
    began = shuffled(spark)
    assert present_values(texts, items.select("project_id", "original"), "project_id", "text", "original").count() == 0
    assert shuffled(spark) - began < 2_800_000


def test_texts_that_hold_no_needle_do_not_travel(spark):
    """2 MB of texts, of which one holds a value; the others are neither exchanged nor sorted."""
    word = many_values(spark)[1]
    texts = [("p", word(1000)) for _ in range(2000)] + [("p", "与甲乙丙丁戊"), ("q", "与甲乙丙丁戊")]
    values = spark.createDataFrame([("p", "甲乙丙丁戊"), ("p", "己庚辛壬癸"), ("q", "己庚辛壬癸")], "project_id string, value string")
    began = shuffled(spark)
    got = present_values(spark.createDataFrame(texts, "project_id string, text string"), values, "project_id", "text", "value").collect()
    assert [tuple(r) for r in got] == [("p", "甲乙丙丁戊")]
    assert shuffled(spark) - began < 1_000_000


def test_restoring_sends_values_once(spark):
    items, word = many_values(spark)
    texts = [("p", i, word(500)) for i in range(300)]
    began = shuffled(spark)
    got = redact(spark.createDataFrame(texts, "project_id string, k int, text string"), items.selectExpr("project_id", "ord", "'x' as original", "'' as replacement", "original as placeholder"), "project_id", "k", "text", restore=True)
    assert sorted(map(tuple, got.collect())) == sorted(texts)
    assert shuffled(spark) - began < 3_300_000


def test_what_is_replaced_is_computed_once(spark):
    """Cells of blocks made distinct by an exchange, and texts restored behind their redaction: no such frame runs to tell its partitions."""
    from veilspark.session import spread

    sc = spark.sparkContext
    sc.setJobGroup("spread", "spread")
    try:
        t = spread(spark.range(1000).selectExpr("id % 700 as k").dropDuplicates(["k"]))
        assert len(sc.statusTracker().getJobIdsForGroup("spread")) == 0
        assert t.count() == 700
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_present_values(spark):
    t = spark.createDataFrame([("p", "甲乙丙"), ("p", None), ("q", "丁")], "project_id string, text string")
    v = spark.createDataFrame([("p", "乙"), ("p", "乙"), ("p", "丁"), ("q", "丁"), ("q", None), ("q", "")], "project_id string, value string")
    assert sorted(tuple(r) for r in present_values(t, v, "project_id", "text", "value").collect()) == [("p", "乙"), ("q", "丁")]


def test_empty_tables(spark):
    t = spark.createDataFrame([], "project_id string, k int, text string")
    assert redact(t, spark.createDataFrame([], ITEM), "project_id", "k", "text").count() == 0


def test_runs():
    assert redact_runs(["张", "三丰", "来"], [("张三", "人员A")]) == ["人员A", "丰", "来"]
    assert redact_runs(["a张三b"], [("张三", "X")]) == ["aXb"]
