"""Column functions on text: block masks, lengths, trimming, output names."""

from pyspark.sql import functions as F

# The characters that count as white space (Unicode White_Space),
# the block that stands for every other character, and the cell mask.
WHITESPACE = (
    r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
BLOCK = "█"
CELL_MASK = "[MASKED]"
MASKED_SUFFIX = "_masked"

_SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"
# Visible characters of ASCII and Latin-1, each one UTF-16 unit and no white space.
_COMMON = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)]))
_EXTENSION = r"(\.[^./]+)$"
_NAME_AND_EXTENSION = r"^(.*?)(\.[^./]+)?$"


def mask_blocks(col):
    """Every non-white-space UTF-16 unit becomes a block; null and '' stay.

    Common characters go by table lookup, which is much faster than a regex; the
    regexes see only texts that hold others.
    """
    common = F.translate(col, _COMMON, BLOCK * len(_COMMON))
    others = F.length(F.translate(col, _COMMON + " \t\n\r", "")) > 0
    wide = F.regexp_replace(common, _SUPPLEMENTARY, BLOCK * 2)
    every = F.regexp_replace(wide, f"[^{WHITESPACE}]", BLOCK)
    return F.when(others, every).otherwise(common)


def utf16_length(col):
    """Length in UTF-16 units: a supplementary character counts twice."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def trim_whitespace(col):
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col, rf"(?s)^[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def is_blank(col):
    """True for null, '' and text made of white space only."""
    return ~F.coalesce(F.rlike(col, F.lit(f"[^{WHITESPACE}]")), F.lit(False))


def replace_literal(text, value):
    """Replace every occurrence of `value`, case-sensitive and literal, by its mask.

    An empty or null value leaves the text as it is.
    """
    found = F.coalesce(F.length(value) > 0, F.lit(False))
    return F.when(found, F.replace(text, value, mask_blocks(value))).otherwise(text)


def file_extension(path):
    """Lower-case extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(path, _EXTENSION, 1))


def masked_path(path):
    """`<dir>/<name>_masked<ext>`; the extension keeps its case."""
    return F.regexp_replace(path, _NAME_AND_EXTENSION, f"$1{MASKED_SUFFIX}$2")
