"""Ways to detect, in one shape: a function that adds `pii` (and maybe
`detect_status`) to a DataFrame with a `text` column.

One that reads its input more than once says so by an attribute `rereads`; a job that has
an input which is dear to make writes it first then."""

from pyspark.sql import functions as F

from maskwright.functions.detect import rule_pii
from maskwright.functions.entities import pii_struct
from maskwright.operators.gazetteer import detect_gazetteer
from maskwright.operators.inference import infer_pii
from maskwright.schema import FAILED, KINDS, PARSE_FAILED


def by_rules(rules=rule_pii):
    """A column function `text → pii struct`; no shuffle, works on streams."""
    return lambda docs: docs.withColumn("pii", rules(F.col("text")))


def by_dictionary(dictionary, id_col="doc_id", **options):
    """A dictionary up to `values_bytes` is searched in the scan, so it works on streams as well."""
    return lambda docs: detect_gazetteer(docs, dictionary, id_col, "text", **options)


def by_model(make_model, id_col="doc_id", **options):
    def detect(docs):
        return infer_pii(docs, make_model, id_col, **options)

    detect.rereads = True
    return detect


def combined(*detectors):
    """The lists of several detectors, one after the other per kind; of their outcomes the
    worst counts."""

    def detect(docs):
        out, outcomes = docs, []
        for i, detector in enumerate(detectors):
            out = detector(out).withColumnRenamed("pii", f"_pii{i}")
            if "detect_status" in out.columns:
                outcomes.append(f"_status{i}")
                out = out.withColumnRenamed("detect_status", outcomes[-1])
        if outcomes:
            seen = F.array(*outcomes)
            worst = F.when(F.array_contains(seen, FAILED), F.lit(FAILED)).when(
                F.array_contains(seen, PARSE_FAILED), F.lit(PARSE_FAILED))
            out = out.withColumn("detect_status", worst).drop(*outcomes)
        lists = {
            kind: F.concat(*[F.col(f"_pii{i}")[kind] for i in range(len(detectors))])
            for kind in KINDS
        }
        return out.withColumn("pii", pii_struct(**lists)).drop(
            *[f"_pii{i}" for i in range(len(detectors))]
        )

    detect.rereads = any(getattr(d, "rereads", False) for d in detectors)
    return detect
