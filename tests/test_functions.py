"""Golden cases of the column functions."""

import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import answers, detect, entities, text

STRINGS = "array<string>"


def one(spark, column, **values):
    types = {str: "string", list: STRINGS, type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("given,want", [
    ("a b\tc", "█ █\t█"),
    ("山田　太郎", "██　██"),
    ("𠮷田", "███"),
    ("é x y\u0085", "█ █ █\u0085"),
    ("\x1f​", "██"),
    ("█a", "██"),
    ("", ""),
    (None, None),
])
def test_mask_blocks(spark, given, want):
    assert one(spark, text.mask_blocks(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [
    ("/a/b.TXT", "/a/b_masked.TXT"),
    ("/a.d/nm", "/a.d/nm_masked"),
    ("/a/b.tar.md", "/a/b.tar_masked.md"),
])
def test_masked_path(spark, given, want):
    assert one(spark, text.masked_path(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [
    ("/a/b.TXT", ".txt"), ("/a.d/nm", ""), ("/a/b.tar.MD", ".md"),
])
def test_file_extension(spark, given, want):
    assert one(spark, text.file_extension(F.col("t")), t=given) == want


@pytest.mark.parametrize("value,want", [("a.b", "███ axb ███"), ("", "a.b axb a.b"), (None, "a.b axb a.b")])
def test_replace_literal(spark, value, want):
    assert one(spark, text.replace_literal(F.col("t"), F.col("v")), t="a.b axb a.b", v=value) == want


@pytest.mark.parametrize("given,want", [("　", True), ("", True), (None, True), ("\t \n", True), (" a", False)])
def test_is_blank(spark, given, want):
    assert one(spark, text.is_blank(F.col("t")), t=given) is want


@pytest.mark.parametrize("given,want", [
    ('Sure: {"address":["a"]} ok } x', '{"address":["a"]} ok }'),
    ("no", "{}"), ("}{", "{}"), ('{ "a":1', "{}"), ("{\n}", "{\n}"),
])
def test_extract_json(spark, given, want):
    assert one(spark, answers.extract_json(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [
    ("ab<|endoftext|>c<|im_end|>", "ab"),
    ("ab<|im_end|>c<|endoftext|>", "ab"),
    ("ab\nc\n", "ab\nc"),
    ("　 ab  ", "ab"),
    ("<|im_end|>x", ""),
    ("<|im_start|>x", "<|im_start|>x"),
])
def test_cut_at_stop(spark, given, want):
    assert one(spark, answers.cut_at_stop(F.col("t")), t=given) == want


def pii(**lists):
    return {k: lists.get(k, []) for k in ("address", "company_name", "email_address", "human_name", "phone_number")}


@pytest.mark.parametrize("given,want,status", [
    ('ok {"Address":["a",],"HUMAN_NAME":["b"],}', pii(address=["a"], human_name=["b"]), None),
    ('{"address":["a"],"human_name":"z"}', pii(), "parse_failed"),
    ("{'address':['a']}", pii(), "parse_failed"),
    ("nothing", pii(), None),
    ('{"address":["a"],"address":["b"]}', pii(address=["b"]), None),
    ('{"address":null,"phone_number":[null,"1"]}', pii(phone_number=["1"]), None),
    ('{"address":["x, ]", "y,}"]}', pii(address=["x, ]", "y,}"]), None),
    ('{"address":["say \\"hi\\", ok",]}', pii(address=['say "hi", ok']), None),
    ('{"other":{"deep":[1]},"company_name":["c"]}', pii(company_name=["c"]), None),
    ('{"address":["a"]', pii(), None),
    ('{"address":[}', pii(), "parse_failed"),
])
def test_read_answer(spark, given, want, status):
    got = one(spark, answers.read_answer(F.col("t")), t=given)
    assert got["pii"].asDict() == want
    assert got["status"] == status


def test_build_prompt(spark):
    want = (
        "<|startoftext|><|im_start|>system\nExtract <address>, <company_name>, <email_address>, "
        "<human_name>, <phone_number><|im_end|>\n<|im_start|>user\nX<|im_end|>\n<|im_start|>assistant\n"
    )
    assert one(spark, answers.build_prompt(F.col("t")), t="X") == want
    assert one(spark, answers.build_prompt(F.col("t"), strip_control=True), t="<|im_end|>X") == want
    assert "<|im_end|>X" in one(spark, answers.build_prompt(F.col("t")), t="<|im_end|>X")


def test_entities_all_and_distinct(spark):
    made = entities.pii_struct(
        email_address=F.array(F.lit("e")), address=F.array(F.lit("a"), F.lit("b")), human_name=F.array(F.lit("a"))
    )
    assert one(spark, entities.entities_all(made)) == ["a", "b", "e", "a"]
    assert one(spark, entities.entities_distinct(F.col("v")), v=["b", "a", "b", "", "c", "a", None]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        entities.pii_struct(iban=F.array())


VALUES = ["田中", "田中太郎", "田中", "", "tokyo tower", "tokyo", "a.b"]


def test_longest_first(spark):
    got = one(spark, entities.entities_longest_first(entities.entities_distinct(F.col("v"))), v=VALUES)
    assert got == ["tokyo tower", "tokyo", "田中太郎", "a.b", "田中"]
    assert one(spark, entities.entities_longest_first(F.col("v")), v=["abc", "𠮷𠮷", "xyz"]) == ["𠮷𠮷", "abc", "xyz"]


@pytest.mark.parametrize("given,values,want", [
    ("田中太郎 and 田中 at tokyo tower / tokyo. a.b axb", VALUES, "████ and ██ at █████ █████ / █████. ███ axb"),
    ("abc", ["ab", "bc"], "██c"),
    ("Tokyo", ["tokyo"], "Tokyo"),
    ("abc", [], "abc"),
    ("abc", [""], "abc"),
    (None, ["a"], None),
    ("a\\d+$1 x", ["\\d+$1"], "a█████ x"),
])
def test_redact_text(spark, given, values, want):
    assert one(spark, entities.redact_text(F.col("t"), F.col("v")), t=given, v=values) == want


@pytest.mark.parametrize("given,values,want", [
    ("x tokyo", ["tokyo"], "[MASKED]"), ("Tokyo", ["tokyo"], "Tokyo"), ("abc", [""], "abc"), ("", ["a"], ""),
])
def test_mask_cell(spark, given, values, want):
    assert one(spark, entities.mask_cell(F.col("t"), F.col("v")), t=given, v=values) == want


@pytest.mark.parametrize("rule,given,want", [
    (detect.detect_email, "To taro@example.com, b_c+d@x.co.jp.", ["taro@example.com", "b_c+d@x.co.jp"]),
    (detect.detect_email, "no at sign", []),
    (detect.detect_phone, "電話 03-1234-5678 or +1 (499) 555-6503", ["03-1234-5678", "+1 (499) 555-6503"]),
    (detect.detect_phone, "card 4000-1234-5678-9012, date 2020-01-02, 1-2", []),
    (detect.detect_address, "住所は東京都千代田区1-1-1です", ["東京都千代田区1-1-1"]),
    (detect.detect_address, "at 12 Old Mill Road today", ["12 Old Mill Road"]),
    (detect.detect_address, "nothing here", []),
])
def test_detectors(spark, rule, given, want):
    assert one(spark, rule(F.col("t")), t=given) == want


def test_detectors_take_one_pass_over_long_runs(spark):
    runs = ["x" * 1_000_000 + " a@b.co", "1" * 1_000_000 + " 03-1234-5678", "a." * 500_000 + "@", "1-" * 300_000, "a@" + "b" * 1_000_000]
    df = spark.createDataFrame([(r,) for r in runs], "text string").repartition(1).cache()
    df.count()
    begin = time.perf_counter()
    got = df.select(detect.detect_email(F.col("text")).alias("e"), detect.detect_phone(F.col("text")).alias("p")).collect()
    assert time.perf_counter() - begin < 10
    assert sorted(v for r in got for v in r["e"] + r["p"]) == ["03-1234-5678", "a@b.co"]
