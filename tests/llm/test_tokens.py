import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm.tokens import DEFAULT_VOCABULARY, WORD_PATTERN, SpeculativeBpe, encode

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    mine = SpeculativeBpe(DEFAULT_VOCABULARY)
    return mine, tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


def ids(mine, texts):
    offsets, flat = mine.encode_batch(texts)
    return [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]


def test_cases(both):
    mine, theirs = both
    texts = ["", None, " ", "Hello  world\n\n don't", "中文字符，测试。", "<|endoftext|>", "é́​😀", "a" * 3000, "中" * 2000, "0123456789" * 50, "\u0000퟿"]
    assert ids(mine, texts) == [theirs.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(both, texts):
    mine, theirs = both
    assert ids(mine, texts) == [theirs.encode_ordinary(t) for t in texts]


def test_long_words_are_merged_exactly(both):
    mine, _ = both
    import random

    random.seed(3)
    for _ in range(60):
        b = bytes(random.choice(b"abcdelnorst") for _ in range(random.randrange(1, 60)))
        parts = [bytes([x]) for x in b]
        while True:
            best = min(((mine.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert mine.merge(b) == [mine.ranks[p] for p in parts]


def test_memory_is_bounded():
    small = SpeculativeBpe(DEFAULT_VOCABULARY, remember=3)
    a = ids(small, ["one two three four five"])
    assert ids(small, ["one two three four five"]) == a and ids(small, ["six seven eight nine"]) == ids(SpeculativeBpe(DEFAULT_VOCABULARY), ["six seven eight nine"])


def test_frame(spark, both):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode(df, "doc_id", "text").collect())
    x = both[1].encode_ordinary("a b")
    assert got == [(1, x), (2, []), (3, []), (4, x), (4, x)]
    assert encode(df.limit(0), "doc_id", "text").count() == 0
