"""Encoding against tiktoken, decoding as an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import byte_bpe


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(*byte_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], "<u4").tolist()


ODD = ["", " ", "a", "   b\n\n c ", "don't we'll THEY'RE 's", "naïve Ünï_code __x__", "日本語とemoji 👩‍👩‍👧 ok", "²³½ Ⅷ", "\x1c\x1f\x85 x", "<|endoftext|>",
       "12345 ६७ 3.14", "   wide", "a\tb\r\nc", "ﬁ ŉ ǆ", "x" * 5000, "ab" * 3000, "!?" * 2000, "\U00020000\U000323af"]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(own, reference, text):
    assert ids_of(own, text) == reference.encode_ordinary(text)
    assert own.decode(own.encode([text])) == [text.encode("utf-8")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(own, reference, text):
    assert ids_of(own, text) == reference.encode_ordinary(text)
    assert own.decode(own.encode([text])) == [text.encode("utf-8")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=40))
def test_any_ids_decode_to_their_bytes(own, reference, ids):
    raw = own.decode([np.array(ids, "<u4").tobytes()])[0]
    assert raw == b"".join(reference.decode_single_token_bytes(i) for i in ids)


def test_forgetting_changes_nothing(own, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    dice = random.Random(1)
    texts = [" ".join(dice.choice(["red", "Green", "blüe", "x1"]) for _ in range(20)) for _ in range(30)]
    assert [ids_of(own, t) for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_offsets_are_those_of_the_characters(own, spark):
    texts = ["plain words", "日本 é👩x", "", None]
    rows = byte_bpe.encode(spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, IDS string"),
                           offsets=True).collect()
    for row in rows:
        text = row["text"] or ""
        at = 0
        for token, start, end in zip(row["ids"], row["starts"], row["ends"]):
            raw = own.decode([np.array([token], "<u4").tobytes()])[0]
            begin = len(text.encode("utf-8")[:at].decode("utf-8", "ignore"))
            assert start == begin and text.encode("utf-8")[at:at + len(raw)] == raw
            at += len(raw)
            assert end == len(text) - len(text.encode("utf-8")[at:].decode("utf-8", "ignore"))
        assert at == len(text.encode("utf-8"))


def test_query_shape_and_round_trip(spark, reference):
    texts = ["One two", None, "", "日本", "One two", "w " * 40_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = byte_bpe.round_trip(frame).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = reference.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode("utf-8")).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(frame.select("doc_id", "text"))).collect()
    assert all(bytes(r["decoded"]).decode("utf-8") == (r["text"] or "") == r["decoded_text"] for r in back)


def test_split_characters_come_back_whole(own):
    ids = np.frombuffer(own.encode(["👩"])[0], "<u4")
    assert len(ids) > 1
    whole = own.decode([ids.tobytes()])[0]
    part = own.decode([ids[:1].tobytes()])[0]
    assert byte_bpe.as_text(whole) == "👩" and byte_bpe.as_text(part) == "�"


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
