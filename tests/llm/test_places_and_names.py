import pytest

from veilspark.llm.addresses import Reader, align, same_place, same_places
from veilspark.llm.names import NameReader, common_length, same_names, same_organisation, same_person, suffixes
from veilspark.llm.romanise import osa, reading_tables


@pytest.fixture(scope="module")
def reader(spark):
    return Reader(*reading_tables(spark))


@pytest.fixture(scope="module")
def names(spark):
    return NameReader(*reading_tables(spark))


SAME = [
    ("贵州省鹭岭市屏芦区棠茗路535号", "棠茗路五百三十五號3号楼，屏芦区，鹭岭市，贵州省"), ("贵州 鹭岭市 屏芦区 棠茗路５３５号", "贵州-鹭岭-屏芦区-棠茗路门牌535"), ("贵州省鹭岭市屏芦区棠茗路535号", "No. 535, Tangming Road, Pinglu District, Luling City, Guizhou Province"),
    ("119616 鹭岭市棠茗路535#（水塔旁）", "贵州省鹭岭市屏芦区棠铭路535号12层"), ("265 Sycamore Avenue; TANSYFIELD", "Flat 7A, Sycamore Ave No. 265, TY12 4BP Tansyfield"), ("Suite 9, #265 Sycmore Av., Tansyfield", "tansyfield, 265, sycamore avenue"), ("甘肃岱浦市浦楠区伯薇大道659号", "甘肃省岱浦市浦楠区柏薇大道659号"),
]
OTHER = [("265 Sycamore Avenue, Tansyfield", "267 Sycamore Avenue, Tansyfield"), ("265 Sycamore Avenue, Tansyfield", "265 Sycamore Road, Tansyfield"), ("265 Sycamore Avenue, Tansyfield", "265 Sycamore Avenue, Rookby"), ("鹭岭市屏芦区棠茗路535号", "鹭岭市屏芦区棠茗街535号"), ("鹭岭市屏芦区棠茗路535号", "鹭岭市瑜珩区棠茗路535号"), ("贵州省鹭岭市棠茗路535号", "云南省鹭岭市棠茗路535号")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_place(reader, a, b):
    assert same_place(reader.read(a), reader.read(b))


@pytest.mark.parametrize("a,b", OTHER)
def test_other_place(reader, a, b):
    assert not same_place(reader.read(a), reader.read(b))


@pytest.mark.parametrize("text", [None, "", "   ", "某地", "no number street", "12", "号" * 3000, "路1号"])
def test_unreadable(reader, text):
    assert reader.read(text) is None


def test_alignment():
    assert align(["a", "st"], ["a", "street"]) == 0 and align([], []) == 0
    assert align(["abcde"], ["abcdx"]) == pytest.approx(0.3) and align(["a"], []) == pytest.approx(0.7) and align(["aa", "bb"], []) == pytest.approx(1.05)


def test_place_pairs(spark):
    rows = [(i, a) for i, a in enumerate(x for p in SAME[:2] for x in p)] + [(0, SAME[0][0]), (50, None), (51, "265 Sycamore Avenue, Rookby"), (52, "Sycamore Ave 265, Rookby")]
    got = sorted(tuple(r) for r in same_places(spark.createDataFrame(rows, "entity_id long, original string"), "entity_id", "original").collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (51, 52)]
    assert same_places(spark.createDataFrame([], "entity_id long, original string"), "entity_id", "original").count() == 0


@pytest.mark.parametrize(
    "a,b,how",
    [("孫雲斌", "孙云斌", "strong"), ("Junfei GONG", "龚俊飞", "strong"), ("WANG, Junkai", "王俊凯", "strong"), ("Nichoas Jarnsworth", "Nicholas Jarnsworth", "strong"), ("Thornecroft Gabriella", "Gabriella Thornecroft", "strong"), ("Sue Pellmarsh", "Susannah Pellmarsh", "strong"), ("William D. Kirkbride", "KIRKBRIDE William", "strong"), ("寒丽", "韩丽", "strong"), ("老司马", "司马玲斌", "weak"), ("N.P. Liu", "刘宁鹏", "weak"), ("Zhou, F.B.", "周飞斌", "weak"), ("颖云同志", "周颖云", "weak"), ("Ir. Merrowby", "Katherine Merrowby", "weak"), ("兰鹏", "龚兰鹏", "weak"), ("Peter Vale", "Paul Vale", ""), ("王俊凯", "王俊强", ""), ("N.P. Liu", "刘宁飞", "")],
)
def test_persons(names, a, b, how):
    assert same_person(names.person(a), names.person(b)) == how


@pytest.mark.parametrize(
    "a,b,how",
    [("桦衡市浦晖智能电网股份有限公司", "浦晖智网公司", "strong"), ("澜崖（薇淇）生物医学工程研究院", "薇淇市澜崖生物医学工程研究院", "strong"), ("水务环境公司（禾缨砚澄）", "禾缨 砚澄 水务环境 有限公司", "strong"), ("Huihua Marine Engineering Holdings", "栖瑜市晖桦海洋工程股份有限公司", "strong"), ("WSL Ltd", "Willowline Sensor Laboratories Limited", "weak"), ("Nettlewell Mat. Res. Ltd", "Nettlewell Materials Research Limited", "strong"), ("Battery Solutions, Wytheline", "Wytheline Battery Solutions Institute", "strong"), ("The Drayline Seensor Laborratories GmbH", "Drayline Sensor Laboratories G.m.b.H.", "strong"), ("甲乙市丙丁海洋工程研究院第一分公司", "甲乙市丙丁海洋工程研究院第二分公司", ""), ("A Grid Systems Ltd North Branch", "A Grid Systems Ltd", ""), ("Larkline Grid Systems Ltd", "Larkline Grid Systems Corp.", ""), ("桦衡市浦晖智能电网有限公司", "桦衡市浦晖信息安全有限公司", "")],
)
def test_organisations(names, a, b, how):
    assert same_organisation(names.organisation(a), names.organisation(b)) == how


def test_name_pairs(spark):
    s = "entity_id long, project_id string, original string"
    rows = [(1, "p", "龚俊飞"), (2, "p", "Junfei GONG"), (3, "p", "老龚"), (4, "p", "王强"), (5, "p", "王伟"), (6, "p", "小王"), (7, "q", "龚俊飞"), (8, "p", None), (9, "p", ""), (2, "p", "Junfei GONG"), (10, "p", "老​龚")]
    got = sorted(tuple(r) for r in same_names(spark.createDataFrame(rows, s), "entity_id", ["project_id"], "original", "person").collect())
    assert got == [(1, 2), (1, 3), (1, 10), (2, 3), (2, 10), (3, 10)]
    assert same_names(spark.createDataFrame([], s), "entity_id", ["project_id"], "original", "organization").count() == 0


def test_common_suffixes_are_refined_not_dropped(spark, monkeypatch):
    import veilspark.llm.names as m

    monkeypatch.setattr(m, "COMMON", 3)
    rows = [(i, "p", f"{n} Stone") for i, n in enumerate(["Mary", "Marry", "Peter", "Anna", "Bert", "Carl", "Dora"])]
    got = sorted(tuple(r) for r in m.same_names(spark.createDataFrame(rows, "entity_id long, project_id string, original string"), "entity_id", ["project_id"], "original", "person").collect())
    assert got == [(0, 1)]


def test_parts():
    assert osa("abcd", "acbd") == 1 and osa("abc", "xyz", 1) == 2 and common_length("abcd", "acxd") == 3
    assert suffixes("=abc") == ["=abc"] and "stone" in suffixes("whetstone") and "<whetst" in suffixes("whetstone")


def test_parts_of_any_length_are_compared():
    from veilspark.llm.names import ratio

    long = "tangming " * 60
    slip = long[:270] + "x" + long[271:]
    assert ratio(long, slip) == 2 * 539 / 1080 and ratio(long, long) == 1.0 and ratio("", "") == 0.0
    assert osa(long, slip, 2) == 1 and osa(long, slip[:100] + slip[101:], 2) == 2 and osa(long, "y" * 540, 2) == 3


def test_long_tokens_are_respelled(spark):
    from veilspark.llm.addresses import respell

    for n in (12, 39, 40, 41, 42, 60, 500):
        good = ("abcdefghijklmnopqrstuvwxy" * 30)[:n]
        bad = [good[:5] + "z" + good[6:], good[:-3] + good[-2:], good[: n // 2] + "z" + good[n // 2 :], good[:2] + good[3] + good[2] + good[4:]]
        df = spark.createDataFrame([(good, "latin")] * 9 + [(b, "latin") for b in bad], "street string, script string")
        assert {r["street"] for r in respell(df, "street").collect()} == {good}, n


def test_copies_of_a_hot_project_are_compared_once(spark):
    """A thousand records of few names in one project: classes of readings are linked, and all pairs come out."""
    rows = [(i, "p", f"周建国{'' if i % 2 else ' '}") for i in range(60)] + [(100 + i, "p", "Zhou Jianguo") for i in range(40)] + [(200, "p", None), (None, "p", "周建国"), (0, "p", "周建国 ")]
    df = spark.createDataFrame(rows, "k long, p string, t string")
    assert same_names(df, "k", ["p"], "t", "person").count() == 100 * 99 // 2
