import random

from veilspark.llm.spam import find_spam, measure


def prose(r):
    return "。".join(f"依据评审意见，{r.choice(['通信模块', '数据平台', '控制软件'])}的接口文档与{r.choice(['监控', '识别', '预警'])}模块同步修订，并据此更新了{r.randrange(90)}项记录" for _ in range(8)) + "。"


def test_spam(spark):
    r = random.Random(1)
    rows = [(i, prose(r), "zh") for i in range(300)]
    rows += [(400 + i, f"The work on item {r.randrange(90)} was done by the team, and the record of the test was kept in the plant. " * 3, "en") for i in range(60)]
    links = "\n".join(f"优惠{i}: http://shop{i}.example/p/{i}" for i in range(30))
    words = "、".join(r.choice(["监控平台哪家好", "数据软件批发", "通信模块厂家直销"]) for _ in range(60))
    table = "\n".join(f"模块 | A-{i} | 现货 | ￥{i}9" for i in range(30))
    rows += [(1000, links, "zh"), (1001, words, None), (1002, table, "zh"), (1003, prose(r)[:60] + "。\n" + words, "zh"), (1004, prose(r) + "\n关键词：监控, 数据, 通信", "zh"), (1005, None, "zh"), (1006, "", "zh"), (1007, " \n", None), (1008, "参考：\n" + "\n".join(f"[{i}] {prose(r)[:30]} http://lib.example/{i}, 2019." for i in range(4)) + "\n" + prose(r), "zh"), (1000, links, "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"] for x in find_spam(df, "doc_id", "text", "lang").filter("spam").collect()}
    assert got == {1000, 1001, 1002, 1003}
    assert find_spam(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_measures():
    assert measure("一二的三。")[0] == 1.0 and len(measure("x")) == 5 and measure("\ud800")[2] == 0.0
    assert measure("The work was done in the plant by the team. " * 200)[0] > 0.9
    assert measure("buy cheap pumps, " * 200)[0] == 0.0 and measure("buy cheap pumps, " * 200)[2] > 0.95
    # Long texts are measured like short ones.
    r = random.Random(3)
    short, long = measure("".join(map(prose, [r] * 10))), measure("".join(map(prose, [r] * 1000)))
    assert max(abs(a - b) for a, b in zip(short, long)) < 0.1


def test_repeated_short_lines_are_keywords(spark):
    r = random.Random(2)
    rows = [(i, prose(r), "zh") for i in range(300)]
    rows += [(1000, "低温电解液制备数据集\n" * 100, "zh"), (1001, prose(r)[:60] + "。\n" + "低温电解液制备数据集\n桥梁应力反演数据集\n" * 40, "zh"), (1002, "\n".join(f"第{i}章 监控平台建设" for i in range(40)) + "\n" + prose(r), "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"] for x in find_spam(df, "doc_id", "text", "lang").filter("spam").collect()}
    assert got == {1000, 1001}


def test_the_distance_decides(spark):
    """Keywords without any word that sells, and without separators, are as far from prose as others."""
    r = random.Random(4)
    names = [a + b for a in ("电解液", "反应堆", "绝缘子", "变压器") for b in ("数据集", "评估", "样机", "台架")]
    rows = [(i, prose(r), "zh") for i in range(200)] + [(1000, " ".join(r.choice(names) for _ in range(90)), "zh"), (1001, prose(r) + "\n" + " ".join(names[:4]), "zh")]
    x = {y["doc_id"]: y for y in find_spam(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert x[1000]["spam"] and x[1000]["d2"] > 144 and not x[1001]["spam"]


def test_a_third_of_spam_does_not_move_the_bulk(spark):
    r = random.Random(5)
    rows = [(i, prose(r), "zh") for i in range(200)] + [(1000 + i, f"泵{i}现货 | 阀{i}热卖 | " * 20, "zh") for i in range(100)] + [(1, None, None)]
    got = {x["doc_id"] for x in find_spam(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").filter("spam").collect()}
    assert got == {1000 + i for i in range(100)}
