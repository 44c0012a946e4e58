"""Properties over random texts, evaluated by Spark in one batch per run."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import answers, entities, text

ALPHABET = st.sampled_from(list("abcAB .,{}\"\n\t") + ["　", "\u0085", "田", "é", "𠮷", "█", "$", "\\"])
TEXTS = st.text(ALPHABET, max_size=30)
SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
BLANKS = set(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def units(s):
    return len(s.encode("utf-16-be")) // 2


def mask(s):
    return "".join(c if c in BLANKS else "█" * units(c) for c in s)


def redact(s, values):
    seen = [v for v in dict.fromkeys(values) if v]
    for v in sorted(seen, key=units, reverse=True):
        s = s.replace(v, mask(v))
    return s


@settings(**SETTINGS)
@given(st.lists(st.tuples(TEXTS, st.lists(st.text(ALPHABET, max_size=4), max_size=5)), min_size=20, max_size=60))
def test_masks(spark, cases):
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t string, v array<string>")
    once = entities.redact_text(F.col("t"), F.col("v"))
    out = df.select(
        "i", text.mask_blocks("t").alias("m"), once.alias("r"), entities.redact_text(once, F.col("v")).alias("rr"),
        text.utf16_length("t").alias("n"), text.trim_whitespace("t").alias("s"), answers.extract_json("t").alias("j"),
        entities.redact_text(F.col("t"), F.array().cast("array<string>")).alias("same"),
    )
    for row in out.collect():
        given_text, values = cases[row["i"]]
        assert row["m"] == mask(given_text) and units(row["m"]) == units(given_text) == row["n"]
        assert row["r"] == redact(given_text, values)
        assert row["same"] == given_text
        assert row["s"] == given_text.strip("".join(BLANKS))
        assert row["j"] == "{}" or (row["j"][0] == "{" and row["j"][-1] == "}")
        plain = [v for v in values if v and "█" not in v and not set(v) <= BLANKS]
        assert not any(v in row["r"] for v in plain)
        if all("█" not in v for v in values):
            assert row["rr"] == row["r"]


def test_entity_order_does_not_change_under_repartition(spark):
    rng = random.Random(5)
    lists = [[rng.choice(["a", "bb", "cc", "ddd", "𠮷"]) for _ in range(8)] for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, v array<string>")
    order = entities.entities_longest_first(entities.entities_distinct(F.col("v")))
    runs = [dict(df.repartition(n).select("i", order.alias("o")).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    for i, values in enumerate(lists):
        assert runs[0][i] == sorted(dict.fromkeys(values), key=units, reverse=True)
