"""The model contract: prompt in, raw answer out, and how an answer is read."""

from pyspark.sql import functions as F

from maskwright.functions.entities import empty_list
from maskwright.functions.text import trim_whitespace
from maskwright.schema import KINDS, PARSE_FAILED, PII_TYPE

# The prompt around the text and the marks that end an answer.
PROMPT_HEAD = (
    "<|startoftext|><|im_start|>system\n"
    "Extract <address>, <company_name>, <email_address>, <human_name>, <phone_number><|im_end|>\n"
    "<|im_start|>user\n"
)
PROMPT_TAIL = "<|im_end|>\n<|im_start|>assistant\n"
STOP_MARKS = ["<|im_end|>", "<|endoftext|>"]

_CONTROL_MARK = r"<\|[A-Za-z_]+\|>"
_UNTIL_STOP = r"(?s)^(.*?)(?:<\|im_end\|>|<\|endoftext\|>|\z)"
_OUTER_BRACES = r"(?s)\{.*\}"
# A string literal, or a comma right before a closing bracket.
_TRAILING_COMMA = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|,(\s*[}\]])'
_CORRUPT = "_corrupt"


def build_prompt(text, strip_control=False):
    """The chat prompt for one text. The text goes in as it is, unless
    `strip_control` asks to take control marks out of it first."""
    body = F.regexp_replace(text, _CONTROL_MARK, "") if strip_control else text
    return F.concat(F.lit(PROMPT_HEAD), body, F.lit(PROMPT_TAIL))


def cut_at_stop(raw):
    """The answer up to its first stop mark, trimmed."""
    return trim_whitespace(F.regexp_extract(raw, _UNTIL_STOP, 1))


def extract_json(answer):
    """From the first `{` to the last `}`; `{}` if there is no such span."""
    span = F.regexp_extract(answer, _OUTER_BRACES, 0)
    return F.coalesce(F.nullif(span, F.lit("")), F.lit("{}"))


def _normalised(json):
    tidy = F.regexp_replace(json, _TRAILING_COMMA, "$1$2")
    for kind in KINDS:
        tidy = F.regexp_replace(tidy, rf'(?i)"{kind}"(\s*:)', f'"{kind}"$1')
    return tidy


def parse_answer(json):
    """`struct<pii, status>` of a JSON answer; `status` is null when it was read.

    Keys match in any case, trailing commas and unknown keys are allowed, null
    lists count as empty and null elements are dropped. An answer of the wrong
    shape gives five empty lists and status `parse_failed`.
    """
    schema = PII_TYPE.simpleString()[len("struct<") : -1].replace(":", " ")
    parsed = F.from_json(
        _normalised(json),
        f"{schema.replace(',', ', ')}, {_CORRUPT} string",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": _CORRUPT},
    )
    # One-element array + transform: the JSON is parsed once, then looked at twice.
    def read(record):
        broken = record.isNull() | record[_CORRUPT].isNotNull()
        lists = [
            F.when(broken | record[kind].isNull(), empty_list())
            .otherwise(F.filter(record[kind], lambda v: v.isNotNull()))
            .alias(kind)
            for kind in KINDS
        ]
        return F.struct(
            F.struct(*lists).alias("pii"),
            F.when(broken, F.lit(PARSE_FAILED)).alias("status"),
        )

    return F.transform(F.array(parsed), read)[0]


def read_answer(raw):
    """Raw model output → `struct<pii, status>`."""
    return parse_answer(extract_json(cut_at_stop(raw)))
