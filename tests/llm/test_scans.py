from veilspark.llm.scans import corrections, find_noise, repair, tokens, vocabulary

EN = "the analysis module was deployed at the northern feeder and the controller was archived with automatic grading"
ZH = "依据评审意见，数据平台的接口文档与监控模块同步修订，预计三月完成收尾。"


def corpus(extra):
    return [(i, EN if i % 2 else ZH) for i in range(60)] + extra


def frame(spark, extra):
    return spark.createDataFrame(corpus(extra), "block_key long, text string")


def test_noise(spark):
    extra = [
        (100, "the analysis modu-\nle was deployed"), (101, "the ana1ysis module"), (102, "the cornroller was archived and the controller"), (103, "数据平台旳接口文档与监控模块"),
        (104, "依据评审意见o数据平台的接口"), (105, "依据评审意见'数据平台"), (106, "完成收尾。共7O件，"), (107, EN.replace(" and ", "\nand ") + "\n- 3 -\nwith automatic grading"),
        (108, EN.replace(" at ", "\nat ")), (109, None), (110, ""), (111, "long-term\nplan and low-temperature work"), (101, "the ana1ysis module"),
        *[(200 + i, "the analysis module was deployed at the northern feeder and then\nDRAFT COPY ONLY\nthe controller was archived with automatic grading and more") for i in range(4)],
    ]
    got = {(r["block_key"], r["noise"]) for r in find_noise(frame(spark, extra), "block_key", "text").collect()}
    assert got == {(100, "hyphen"), (101, "misread"), (103, "misread"), (104, "misread"), (105, "misread"), (106, "misread"), (107, "furniture"), *((200 + i, "furniture") for i in range(4))}


def test_natural_hyphens_are_no_cuts(spark):
    extra = [(300 + i, "the low-temperature feeder and temperature") for i in range(5)] + [(100, "the low-\ntemperature feeder")]
    assert 100 not in {r["block_key"] for r in find_noise(frame(spark, extra), "block_key", "text").collect()}


def test_repair(spark):
    extra = [(100, "the ana1ysis modu-\nle was deployed at the\n- 3 -\nnorthern feeder"), (101, "数据平台旳接口文档与监控\n模块o预计三月"), (102, None)]
    got = {r["block_key"]: r["repaired"] for r in repair(frame(spark, extra), "block_key", "text").collect()}
    assert got[100] == "the analysis module was deployed at the northern feeder"
    assert got[101] == "数据平台的接口文档与监控模块。预计三月" and 102 not in got and got[1] == EN


def test_differences_are_verified(spark):
    v = spark.createDataFrame([("northern", 50), ("northem", 1), ("nothing", 1), ("rnorthen", 1), ("的接", 40), ("旳接", 1), ("旳口", 1)], "token string, n long")
    assert {r["bad"]: r["good"] for r in corrections(v).collect()} == {"northem": "northern", "旳接": "的接"}


def test_tokens():
    assert tokens("Cafés co5ts abc dеplоyed") == ["cafés", "co5ts"] and tokens("") == []
    assert "台的接" in tokens("平台\n的接口") and "的接" in tokens("平台的\n接口")


def test_empty(spark):
    assert find_noise(spark.createDataFrame([], "block_key long, text string"), "block_key", "text").count() == 0
    assert vocabulary(spark.createDataFrame([(None,)], "text string"), "text").count() == 0


def test_long_headers_are_furniture(spark):
    """Headers of any length that is less than the text's width."""
    body = " and ".join([EN] * 2)
    for n in (60, 85, 120):
        head = ("CONTROLLED COPY OF THE NORTHERN FEEDER RECORD FOR INTERNAL REVIEW AND ARCHIVING IN THE LIBRARY OF THE MAIN LABORATORY AND ITS BRANCHES " * 2)[:n].strip()
        extra = [(900 + i, f"{body} and then\n{head}\n{body} and more of item {i}") for i in range(4)]
        got = {r["block_key"] for r in find_noise(frame(spark, extra), "block_key", "text").filter("noise = 'furniture'").collect()}
        assert got == {900 + i for i in range(4)}, n
