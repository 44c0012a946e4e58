"""Edit matching against a plain dynamic programme."""

import random

from maskwright.llm import decontamination as dc


def slow_distance(item, text):
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[j - 1] + 1))
        above = row
    return min(above)


def edited(dice, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = dice.randrange(len(out) + 1)
        kind = dice.random()
        if kind < 0.3:
            out.insert(at, dice.choice(letters))
        elif at < len(out):
            if kind < 0.65:
                out[at] = dice.choice(letters)
            else:
                del out[at]
    return "".join(out)


def test_bit_parallel_distance():
    dice = random.Random(1)
    for _ in range(400):
        item = "".join(dice.choice("abc") for _ in range(dice.randint(1, 90)))
        text = "".join(dice.choice("abc") for _ in range(dice.randint(0, 120)))
        assert dc.least_distance(dc.bits_of(item), len(item), text)[0] == slow_distance(item, text)


def test_nothing_within_budget_is_missed():
    dice = random.Random(2)
    hits = 0
    for _ in range(500):
        item = "".join(dice.choice("abcde") for _ in range(dice.randint(3, 50)))
        noise = ["".join(dice.choice("abcde") for _ in range(dice.randint(0, 40))) for _ in range(2)]
        text = noise[0] + edited(dice, item, dice.randint(0, 9), "abcde") + noise[1]
        for budget in (0.08, 0.2):
            matcher = dc.Matcher([("x", item)], budget)
            true = slow_distance(item, text)
            want = {"x": true} if true <= matcher.items[0].edits else {}
            assert matcher.find(text) == want
            hits += bool(want)
    assert hits > 50


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    dice = random.Random(3)
    items = [(i, " ".join("".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(12))) for i in range(30)]
    docs = [(d, f"Lead {edited(dice, dice.choice(items)[1], dice.randint(0, 8), 'abcdefgh ').upper()}\n tail" if d % 2 else "Clean  text", "own", 9)
            for d in range(40)] + [(100, None, "own", 9), (101, "", "own", 9), (1, "Clean  text", "own", 9)]
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, distance int")
    items_frame = spark.createDataFrame(items + [(5, items[5][1]), (90, None), (91, "")], "item_id long, text string")
    want = set()
    for d, text, *_ in docs:
        for i, item in items:
            shown = dc.plain(item)
            true = slow_distance(shown, dc.plain(text))
            if true <= int(len(shown) * dc.BUDGET):
                want.add((d, i, true))
    for limit in (dc.BLOCK_CHARS, 300):
        monkeypatch.setattr(dc, "BLOCK_CHARS", limit)
        got = [tuple(r) for r in dc.matches(docs_frame, items_frame).collect()]
        assert set(got) == want and len(got) == len(want)
        kept = sorted(r["doc_id"] for r in dc.clean(docs_frame, items_frame).collect())
        hit = {w[0] for w in want}
        assert kept == sorted(d for d, text, *_ in docs if d not in hit or text == "Clean  text")
    assert len(want) > 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert dc.matches(none, items).count() == 0 and dc.matches(some, items).count() == 0
    assert dc.clean(some, items).count() == 1 and dc.clean(none, items).count() == 0
