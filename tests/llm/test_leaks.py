import random

from veilspark.llm.leaks import best_passage, find_leaks, plain, running_hashes, tiles, tiles_by_length

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu amber birch cedar dune ember fjord grove heath islet knoll ledge marsh oasis plain ridge shoal thicket vale weir".split()


def item(seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(60))


def test_tiling_by_brute_force():
    r = random.Random(1)
    for _ in range(60):
        a, b = "".join(r.choice("abc") for _ in range(40)), "".join(r.choice("abc") for _ in range(40))
        t = tiles(a, b, 3)
        assert all(a[i : i + k] == b[j : j + k] and k >= 3 for i, j, k in t)
        for side in (0, 1):
            used = sorted((x[side], x[side] + x[2]) for x in t)
            assert all(p[1] <= q[0] for p, q in zip(used, used[1:]))
        longest = max((k for i in range(40) for j in range(40) for k in range(1, 41) if i + k <= 40 and j + k <= 40 and a[i : i + k] == b[j : j + k]), default=0)
        assert max((k for _, _, k in t), default=0) == (longest if longest >= 3 else 0)


def test_repeating_texts():
    r = random.Random(2)
    for n in range(200):
        letters = "ab" if n % 2 else "abcd"
        a, b = "".join(r.choice(letters) for _ in range(r.randrange(80))), "".join(r.choice(letters) for _ in range(r.randrange(50)))
        assert tiles(a, b, 3) == tiles_by_length(a, b, 3)
    assert tiles("x" * 50_000, "x" * 30_000, 4) == [(0, 0, 30_000)]
    assert sum(k for _, _, k in tiles("ab" * 20_000, "ab" * 300, 4)) == 600


def test_hashes_are_of_windows():
    h = running_hashes("abcdefghijabcdefghij" * 2)
    assert len(h["han"]) == 33 and len(h["other"]) == 25 and h["han"][0] == h["han"][10] and len(running_hashes("short")["han"]) == 0


def test_passage():
    t = [(0, 0, 10), (12, 50, 10), (100, 20, 30)]
    assert best_passage(t, 5, 90) == 1 and best_passage(t[:2], 5, 60) == 1 and best_passage(t[:2], 5, 60, ordered=True) == 0.5
    assert best_passage(t[:2], 5, 60, lambda j, k: 0.07) == 0.5


def test_a_third_in_any_order(spark):
    r = random.Random(5)
    items = [(n, ". ".join(" ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(8)) for _ in range(12))) for n in range(40)]
    docs = []
    for n, t in items:
        parts = t.split(". ")[3:8]
        docs.append((n, f"{item(100 + n)} {'. '.join(reversed(parts))} {item(200 + n)}"))
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert len(got & {(n, n) for n in range(40)}) >= 36 and len(got) <= 40


def test_leaks(spark):
    a, b = item(1), item(2)
    w = a.split()
    half = " ".join(w[10:40])
    swapped = w[5:40]
    swapped[10], swapped[14] = swapped[14], swapped[10]
    zh = "设偏心曲柄每隔二十八分钟翻转一次，曲线在第二个拐点前折返，偏心曲柄先于双瓣阀芯恢复渗出速率，请比较云母垫片和偏心曲柄的渗出速率。"
    filler = item(77) + " " + item(78)
    docs = [(1, f"{filler} {half.upper()} {filler}"), (2, f"{filler}\n{', '.join(swapped)}\n{filler}"), (3, f"{filler} {' '.join(w[:8])} {filler}"), (4, " ".join(w[40:] + w[:40])), (5, None), (6, ""), (7, filler), (8, "前文" + zh.replace("，", "\n ")[:45] + "后文" * 30), (9, f"x{filler}" * 40 + " " + half), (1, f"{filler} {half.upper()} {filler}")]
    items = [(1, a), (2, b), (3, zh), (4, None), (5, ""), (1, a)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect())
    assert got == [(1, 1), (2, 1), (4, 1), (8, 3), (9, 1)]
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    import veilspark.llm.leaks as m

    monkeypatch.setattr(m, "BLOCK_CHARS", 300)
    i = spark.createDataFrame([(n, item(n)) for n in range(4)], "item_id long, text string")
    d = spark.createDataFrame([(n, item(n)) for n in range(4)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in m.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()) == [(n, n) for n in range(4)]


def test_plain():
    assert plain("Ａb, c。\nＤ") == "abcd" and plain("  ") == ""
