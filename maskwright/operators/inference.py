"""Detection by a language model, as a batch function on the workers.

The model itself is the user's: `make_model(**limits)` runs once per Python worker
and returns a function from a list of prompts to a list of raw answers.
"""

from functools import reduce

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.answers import STOP_MARKS, build_prompt, read_answer
from maskwright.functions.entities import empty_list, pii_struct
from maskwright.operators import stitching
from maskwright.operators.joins import skew_join
from maskwright.schema import FAILED, KINDS, PARSE_FAILED
from maskwright.session import durable

# The limits a model is run with.
LIMITS = {"context_tokens": 4096, "max_new_tokens": 512}


def _predictor(make_model):
    def make_predict():
        model = make_model(stop=STOP_MARKS, **LIMITS)

        def one(prompt):
            try:
                return model([prompt])[0]
            except Exception:
                return None  # this text only; its row gets status `failed`

        def predict(prompts):
            batch = [str(p) for p in prompts]
            try:
                answers = model(batch)
            except Exception:
                answers = [one(p) for p in batch]
            return np.array(answers, dtype=object)

        return predict

    return make_predict


def infer_raw(texts, make_model, batch_size=16, strip_control=False):
    """Add `raw`, the model's answer; null where the model failed on the text."""
    ask = predict_batch_udf(
        _predictor(make_model), return_type=T.StringType(), batch_size=batch_size
    )
    return texts.withColumn("raw", ask(build_prompt(F.col("text"), strip_control)))


def _answered(pieces, spread_by, make_model, batch_size, strip_control):
    """`pieces` with the `raw` answer to each text, null where there is none.

    Equal texts are asked once. The answers are written before they are used, so
    that no model call is repeated, or answered differently, by a later stage.
    """
    asked = pieces.filter(F.col("text").isNotNull()).groupBy("text").agg(
        F.count(F.lit(1)).alias("n")
    )
    answers = infer_raw(asked, make_model, batch_size, strip_control).select(
        F.sha2("text", 256).alias("_key"), "raw", "n"
    )
    known = durable(pieces.sparkSession, answers, "answers")
    # Rows without a text find no answer; their keys differ, so they stay apart.
    unasked = F.concat(F.lit("-"), F.xxhash64(*spread_by).cast("string"))
    keyed = pieces.withColumn("_key", F.coalesce(F.sha2("text", 256), unasked))
    return skew_join(
        keyed, known.drop("n"), ["_key"], spread_by, counts=known.select("_key", "n")
    ).drop("_key")


def infer_pii(
    docs, make_model, id_col="doc_id", batch_size=16, max_chars=None,
    chunk_chars=None, overlap_chars=200, reach_chars=0, strip_control=False, with_raw=False,
):
    """Add `pii` and `detect_status` by asking the model about each `text`.

    A text over `max_chars` gets status `failed`. With `chunk_chars` long texts are
    asked about in pieces instead that overlap by `overlap_chars`, and the values are
    those of whole texts: ones that a cut divides come from a neighbouring or a wider
    piece. Where values can be longer than the overlap without any part of them being
    found, `reach_chars` says how long; the places around all cuts are asked about then.
    """
    text = F.col("text")
    if chunk_chars:
        return _infer_chunks(docs, make_model, batch_size, chunk_chars, overlap_chars, reach_chars, strip_control)
    fits = F.lit(True) if max_chars is None else F.length(text) <= max_chars
    # A text that is not asked about stands aside while the others are answered.
    pieces = docs.withColumn("_whole", text).withColumn("text", F.when(fits, text))
    joined = _answered(pieces, [id_col], make_model, batch_size, strip_control)
    joined = joined.withColumn("text", F.col("_whole"))
    read = joined.withColumn("_read", read_answer(F.col("raw")))
    failed = F.col("raw").isNull()
    out = read.withColumn("pii", F.when(failed, pii_struct()).otherwise(F.col("_read.pii")))
    out = out.withColumn(
        "detect_status", F.when(failed, F.lit(FAILED)).otherwise(F.col("_read.status"))
    )
    return out.select(*docs.columns, "pii", "detect_status", *(["raw"] if with_raw else []))


def _infer_chunks(docs, make_model, batch_size, size, overlap, reach, strip_control):
    """Values of whole texts from answers about pieces; see `stitching`.

    Equal texts are cut and asked about once. Every round's answers are written, and
    rounds end when no hit is left open at a cut: a piece asked for is twice as wide as
    the one before, so there are few.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_of", F.coalesce(F.sha2("text", 256), F.concat(F.lit("-"), F.xxhash64(*docs.columns).cast("string"))))
    texts = durable(
        spark,
        keyed.filter(F.col("text").isNotNull()).groupBy("_of").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")),
        "texts",
    )
    new = stitching.pieces(texts, "_of", size, overlap, reach)
    rounds = []
    while True:
        answered = _answered(new, ["_of", "begin", "end"], make_model, batch_size, strip_control)
        read = answered.withColumn("_read", read_answer(F.col("raw"))).select(
            "_of", "begin", "end", "size", "text", F.col("_read.pii").alias("pii"),
            F.col("raw").isNull().alias("_failed"), F.col("_read.status").isNotNull().alias("_broken"),
        )
        found = durable(spark, stitching.placed(read, "_of").drop("text", "pii"), "found")
        rounds.append(found)
        asked = reduce(DataFrame.unionByName, rounds)
        hits = found.select("_of", "size", F.explode("hits").alias("h")).select("_of", "size", "h.*")
        wanted = durable(spark, stitching.open_places(hits, asked, "_of", size), "wanted")
        if wanted.isEmpty():
            break
        new = stitching.wider_pieces(texts, "_of", wanted)
    every = asked.select("_of", F.explode("hits").alias("h")).select("_of", "h.*")
    marks = asked.groupBy("_of").agg(F.bool_or("_failed").alias("_failed"), F.bool_or("_broken").alias("_broken"))
    per_text = marks.join(stitching.stitched(every, "_of"), "_of", "left")
    joined = skew_join(keyed, per_text, ["_of"], docs.columns, counts=texts.select("_of", "n"))
    status = (
        F.when(F.coalesce(F.col("_failed"), F.lit(True)), F.lit(FAILED))
        .when(F.col("_broken"), F.lit(PARSE_FAILED))
    )
    lists = {kind: F.coalesce(F.col(kind), empty_list()) for kind in KINDS}
    return joined.select(
        *docs.columns, pii_struct(**lists).alias("pii"), status.alias("detect_status")
    )
