"""Table job: texts in, masked texts with counts and outcome out."""

from pyspark.sql import functions as F

from maskwright.operators.entities import count_columns, with_values
from maskwright.operators.masking import redact_documents
from maskwright.plans.detectors import by_rules
from maskwright.schema import CLEAN, FAILED, MASKED, PARSE_FAILED

QUARANTINE = "quarantine"
COPY = "copy"


def detect_values(docs, detect=None):
    """Add `pii`, `detect_status` and the distinct `values` to be masked."""
    found = (detect or by_rules())(docs)
    if "detect_status" not in found.columns:
        found = found.withColumn("detect_status", F.lit(None).cast("string"))
    return with_values(found)


def outcome(error=None):
    """Status of a document that went through detection."""
    failed = F.coalesce(F.col("detect_status") == FAILED, F.lit(False))
    if error is not None:
        failed = failed | error.isNotNull()
    return (
        F.when(failed, F.lit(FAILED))
        .when(F.col("detect_status") == PARSE_FAILED, F.lit(PARSE_FAILED))
        .when(F.coalesce(F.size("values"), F.lit(0)) > 0, F.lit(MASKED))
        .otherwise(F.lit(CLEAN))
    )


def released(status, on_parse_error=QUARANTINE):
    """Whether a document may be passed on. What failed never is; an answer that
    could not be read is held back, or let through unmasked with `copy`."""
    if on_parse_error not in (QUARANTINE, COPY):
        raise ValueError(f"on_parse_error: {on_parse_error}")
    held = [FAILED] + ([PARSE_FAILED] if on_parse_error == QUARANTINE else [])
    return ~status.isin(held)


def mask_documents(docs, detect=None, id_col="doc_id", on_parse_error=QUARANTINE):
    """`(doc_id, masked_text, status, n_values, n_<kind>..., text_len)`.

    With a rule detector this is one narrow stage: every row is read, detected and
    masked where it lies. A document without personal data comes out unchanged.
    """
    found = detect_values(docs, detect)
    masked = redact_documents(found.withColumn("status", outcome()))
    free = released(F.col("status"), on_parse_error)
    return masked.select(
        id_col,
        F.when(free, F.col("masked_text")).alias("masked_text"),
        "status",
        F.coalesce(F.size("values"), F.lit(0)).cast("long").alias("n_values"),
        *count_columns(F.col("pii")),
        F.length("text").cast("long").alias("text_len"),
    )


def passthrough_clean(docs, detect=None, id_col="doc_id"):
    """Only the documents without personal data, unchanged."""
    found = detect_values(docs, detect).filter(F.coalesce(F.size("values"), F.lit(0)) <= 0)
    return found.select(id_col, F.col("text").alias("masked_text"))
