from collections import Counter

import pytest

from veilspark.llm.mojibake import GarbleModel, fit_model, repair_columns

CLEAN = ["依据评审意见，通信模块通过第五阶段评审，预计三月完成收尾。", "项目名称与合同编号见附件，温度不超过 40 °C ± 2 µm。", "The procédé sheet – “crème”‑grade naïve façade.", "Größe 12 µm – geprüft", "시험 결과 양호함.", "試験の結果は良好でした。", "Осторожно, хрупкий груз.", "Çelik Üretim"]


@pytest.fixture(scope="module")
def model():
    c = Counter()
    for t in CLEAN:
        c.update(t * 400)
    c.update("依据评审意见通信模块通过阶段预计完成收尾，。" * 4000)
    return GarbleModel(dict(c))


@pytest.mark.parametrize("text", [*CLEAN, "", None, "plain ascii", "Ａ全角　text", "a​b"])
def test_correct_text_is_left_alone(model, text):
    assert model.repair(text) == (False, text)


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp437", "koi8_r", "gb18030"])
@pytest.mark.parametrize("text", [CLEAN[0][:24], CLEAN[2]])
def test_round_trip(model, wrong, text):
    raw = text.encode("utf-8")
    bad = "".join(chr(b) if wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(wrong) for b in raw) if wrong != "gb18030" else raw.decode(wrong, "replace")
    garbled, new = model.repair(bad)
    assert garbled
    if "�" not in bad:
        assert new == text


def test_layers_parts_and_losses(model):
    text = CLEAN[0][:12]
    once = text.encode().decode("latin-1")
    assert model.repair(once.encode().decode("latin-1")) == (True, text)
    assert model.repair(CLEAN[0] + "Â°C".replace("Â°", "°".encode().decode("latin-1")) + "，完成")[0]
    assert model.repair("��abc")[0] and model.repair("xy")[0] and model.repair("a\x81")[0]
    gbk = "依据评审意见".encode("gbk").decode("latin-1")
    assert model.repair(gbk) == (True, "依据评审意见")


def test_frame(spark):
    good = CLEAN[0]
    bad = good.encode().decode("cp437")
    rows = [(i, good, "名称.txt", 1) for i in range(200)] + [(900, bad, None, 1), (900, bad, None, 1), (901, None, bad, 2), (902, "", "", 3)]
    df = spark.createDataFrame(rows, "block_key long, text string, source_file string, restored int")
    got = sorted(tuple(r) for r in repair_columns(df, "block_key", ["text", "source_file"]).distinct().collect())
    assert got == [(900, "text", good), (901, "source_file", good)]
    flags = sorted(tuple(r) for r in repair_columns(df, "block_key", ["text", "source_file"], restore=False).select("block_key", "field").distinct().collect())
    assert flags == [(900, "text"), (901, "source_file")]
    assert repair_columns(df.limit(0), "block_key", ["text"], fit_model(df, ["text"])).count() == 0


@pytest.mark.parametrize("layers", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437"])
def test_any_number_of_layers(model, wrong, layers):
    text = CLEAN[0][:16]
    bad = text
    for _ in range(layers):
        bad = bad.encode("utf-8").decode(wrong)
    assert model.repair(bad) == (True, text)
