"""Column functions on entity lists: flatten, distinct, order, and apply them."""

from pyspark.sql import functions as F

from maskwright.functions.text import CELL_MASK, mask_blocks, utf16_length
from maskwright.schema import KINDS


def empty_list():
    return F.array().cast("array<string>")


def pii_struct(**lists):
    """The five lists as one struct; kinds that are not given are empty."""
    unknown = set(lists) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return F.struct(*[lists.get(kind, empty_list()).alias(kind) for kind in KINDS])


def entities_all(pii):
    """The five lists concatenated in kind order."""
    return F.concat(*[F.coalesce(pii[kind], empty_list()) for kind in KINDS])


def entities_distinct(values):
    """Distinct values, first seen first, without nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda v: F.length(v) > 0))


def entities_longest_first(values):
    """Longest value first (UTF-16 length); equal lengths keep their order."""
    keyed = F.transform(
        values,
        lambda v, i: F.struct((-utf16_length(v)).alias("key"), i.alias("at"), v.alias("value")),
    )
    return F.transform(F.array_sort(keyed), lambda item: item["value"])


def mask_pairs(values):
    """Replacement list of a document: `array<struct<value, mask>>`, longest first.

    Built once per document, so that each text run only replaces.
    """
    ordered = entities_longest_first(entities_distinct(values))
    return F.transform(
        ordered, lambda v: F.struct(v.alias("value"), mask_blocks(v).alias("mask"))
    )


def apply_masks(text, pairs):
    """Replace value after value over the already changed text."""
    replaced = F.aggregate(
        pairs, text, lambda acc, pair: F.replace(acc, pair["value"], pair["mask"])
    )
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, text).otherwise(replaced)


def redact_text(text, values):
    """Mask all values of a list in a text: distinct, longest first, in turn."""
    return apply_masks(text, mask_pairs(values))


def holds_any(text, values):
    """True if the text contains any of the (non-empty) values."""
    return F.coalesce(
        F.exists(values, lambda v: (F.length(v) > 0) & F.contains(text, v)), F.lit(False)
    )


def mask_cell(text, values):
    """A cell that contains any value becomes exactly `[MASKED]`."""
    return F.when(holds_any(text, values), F.lit(CELL_MASK)).otherwise(text)
