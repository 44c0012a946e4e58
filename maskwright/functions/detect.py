"""Rule detectors: text in, `array<string>` in text order out.

They stand in for a model where none is at hand. Each one looks for a cheap
literal first, so that the regex runs only over texts that can match.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from maskwright.functions.entities import empty_list, pii_struct

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The same values in one pass: a match starts at the start of a run (or after a match)
# and takes its characters for good, where EMAIL tries again from each character.
_EMAIL_ONCE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# A bracketed area code, or a whole run of hyphenated digits; of the runs only
# those shaped like a domestic number with trunk prefix 0 are kept.
PHONE = r"\+?\d{0,2} ?\(\d{3}\) ?\d{3}-\d{4}|\d+(?:-\d+)+"
_PHONE_ONCE = r"\+?\d{0,2} ?\(\d{3}\) ?\d{3}-\d{4}|(?:\G|(?<!\d))\d++(?:-\d++)++"
DOMESTIC_PHONE = r"^0\d{1,4}-\d{1,4}-\d{4}$"

# Prefecture, municipality and block numbers; or number, street name, street type.
_PREFECTURE_MARKS = ["都", "道", "府", "県"]
_STREET_TYPES = ["Street", "Avenue", "Road", "Boulevard", "Lane", "Drive"]
_BLOCK_NUMBER = r"[0-9０-９]{1,4}"
ADDRESS = (
    rf"[\x{{4E00}}-\x{{9FFF}}]{{2,3}}[{''.join(_PREFECTURE_MARKS)}]"
    r"[\x{3005}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{1,20}"
    rf"{_BLOCK_NUMBER}(?:(?:丁目|番地|番|号|[-－−‐]){_BLOCK_NUMBER}){{0,3}}号?"
    rf"|[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,4}}(?:{'|'.join(_STREET_TYPES)})"
)


def _holds(text, needles):
    return reduce(or_, [F.contains(text, F.lit(needle)) for needle in needles])


def _matches(text, guard, pattern):
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, found).otherwise(empty_list())


def detect_email(text):
    return _matches(text, _holds(text, ["@"]), _EMAIL_ONCE)


def detect_phone(text):
    guard = _holds(text, ["-"]) & (_holds(text, ["("]) | F.rlike(text, F.lit(r"\d-\d")))
    runs = _matches(text, guard, _PHONE_ONCE)
    return F.filter(
        runs, lambda v: F.contains(v, F.lit("(")) | F.rlike(v, F.lit(DOMESTIC_PHONE))
    )


def detect_address(text):
    # ASCII texts, whose bytes are as many as their characters, skip the first four.
    beyond_ascii = F.octet_length(text) > F.length(text)
    guard = (beyond_ascii & _holds(text, _PREFECTURE_MARKS)) | _holds(text, _STREET_TYPES)
    return _matches(text, guard, ADDRESS)


def rule_pii(text):
    """All rule detectors as one `pii` struct."""
    return pii_struct(
        address=detect_address(text),
        email_address=detect_email(text),
        phone_number=detect_phone(text),
    )
