"""DuckDB SQL for every query of `queries.py`, written on its own terms.

Fragments below are SQL expressions as text; `found()` and its kin are WITH lists.
"""

WS = (
    r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d{0,2} ?\(\d{3}\) ?\d{3}-\d{4}|\d+(?:-\d+)+"
DOMESTIC = r"^0\d{1,4}-\d{1,4}-\d{4}$"
ADDRESS = (
    r"[\x{4E00}-\x{9FFF}]{2,3}[都道府県][\x{3005}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{1,20}"
    r"[0-9０-９]{1,4}(?:(?:丁目|番地|番|号|[-－−‐])[0-9０-９]{1,4}){0,3}号?"
    r"|[0-9]{1,5} (?:[A-Z][a-z]+ ){1,4}(?:Street|Avenue|Road|Boulevard|Lane|Drive)"
)
KINDS = ["address", "company_name", "email_address", "human_name", "phone_number"]
NONE = "CAST([] AS VARCHAR[])"
MARK = "chr(31)"


def mask(x):
    wide = rf"regexp_replace({x}, '[\x{{10000}}-\x{{10FFFF}}]', '██', 'g')"
    return f"regexp_replace({wide}, '[^{WS}]', '█', 'g')"


def length16(x):
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def emails(x):
    return f"regexp_extract_all({x}, '{EMAIL}')"


def phones(x):
    return (
        f"list_filter(regexp_extract_all({x}, '{PHONE}'), "
        f"lambda p: contains(p, '(') OR regexp_matches(p, '{DOMESTIC}'))"
    )


def addresses(x):
    return f"regexp_extract_all({x}, '{ADDRESS}')"


def first_seen(items):
    """Distinct, in order: keep an element where it occurs first."""
    return f"list_filter({items}, lambda v, i: length(v) > 0 AND list_position({items}, v) = i)"


def longest_first(items):
    keyed = f"list_transform({items}, lambda v, i: {{'k': -{length16('v')}, 'i': i, 'v': v}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.v)"


def redact(x, ordered):
    return f"list_reduce({ordered}, lambda a, p: replace(a, p, {mask('p')}), {x})"


def flat(items):
    return f"array_to_string({items}, {MARK})"


def flat_kinds(prefix=""):
    return ", ".join(f"{flat(prefix + k)} AS {k}" for k in KINDS)


def counts():
    return ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in KINDS)


def detected(source="documents", key="doc_id", keep="lang, source", body="text", lists=None):
    """CTEs `lists`, `items`, `found(…, five lists, items, vals, ordered)`."""
    lists = lists or {
        "address": addresses(body), "email_address": emails(body), "phone_number": phones(body)
    }
    columns = ", ".join(f"{lists.get(k, NONE)} AS {k}" for k in KINDS)
    return f"""
    lists AS (SELECT {key}, {keep}, {body} AS text, {columns} FROM {source}),
    items AS (SELECT *, list_concat(list_concat(address, company_name),
        list_concat(email_address, list_concat(human_name, phone_number))) AS items FROM lists),
    vals AS (SELECT *, {first_seen('items')} AS vals FROM items),
    found AS (SELECT *, {longest_first('vals')} AS ordered FROM vals)"""


FOUND = "WITH " + detected()
MASKED_STATUS = "CASE WHEN len(vals) > 0 THEN 'masked' ELSE 'clean' END"

# A line per row; line numbers from 0.
LINES = """SELECT doc_id, lang, source, unnest(range(len(ls))) AS line, unnest(ls) AS text
    FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"""

# Paths of the documents as files.
EXT = """CASE lang WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.pptx' WHEN 'es' THEN '.xlsx' ELSE '.TXT' END"""
OFFICE_EXT = "CASE lang WHEN 'fr' THEN '.pptx' WHEN 'es' THEN '.xlsx' ELSE '.docx' END"


def path(ext, suffix=""):
    return f"concat('/c/', source, '/', doc_id, '{suffix}', {ext})"


# Text of a document read back from a file of its type. A slide holds 8 lines;
# blank lines do not show on slides and in sheets.
_LS = "string_split(text, chr(10))"
_IS_TEXT = f"regexp_matches(v, '[^{WS}]')"


def docx_text(lines):
    return f"array_to_string(list_transform({lines}, lambda v: v || chr(10)), '')"


def pptx_text(lines):
    return (
        f"array_to_string(list_transform({lines}, lambda v, i: "
        f"CASE WHEN {_IS_TEXT} THEN v || ' ' ELSE '' END || "
        f"CASE WHEN i % 8 = 0 OR i = len({lines}) THEN chr(10) ELSE '' END), '')"
    )


def xlsx_text(lines):
    return (
        f"array_to_string(list_transform(list_filter({lines}, lambda v: {_IS_TEXT}), "
        "lambda v: v || ' '), '')"
    )


def file_text(lines=_LS, ext=EXT, whole="text"):
    return (
        f"CASE {ext} WHEN '.docx' THEN {docx_text(lines)} WHEN '.pptx' THEN {pptx_text(lines)} "
        f"WHEN '.xlsx' THEN {xlsx_text(lines)} ELSE {whole} END"
    )


def corpus(ext):
    """`found` over documents as files, and `done` with the masked lines and text.

    A Word run is a sentence, so its lines are masked sentence by sentence.
    """
    sentences = "list_transform(string_split(v, '. '), lambda s, i: s || CASE WHEN i < len(string_split(v, '. ')) THEN '. ' ELSE '' END)"
    by_sentence = f"array_to_string(list_transform({sentences}, lambda s: {redact('s', 'ordered')}), '')"
    by_line = redact("v", "ordered")
    by_cell = "CASE WHEN len(list_filter(ordered, lambda p: contains(v, p))) > 0 THEN '[MASKED]' ELSE v END"
    return f"""WITH read AS (SELECT doc_id, lang, source, text AS body, {_LS} AS ls,
        {ext} AS ext, {file_text(ext=ext)} AS text FROM documents),
    {detected('read', 'doc_id', 'lang, source, body, ls, ext')},
    masked AS (SELECT *, CASE ext
        WHEN '.docx' THEN list_transform(ls, lambda v: {by_sentence})
        WHEN '.pptx' THEN list_transform(ls, lambda v: {by_line})
        WHEN '.xlsx' THEN list_transform(ls, lambda v: {by_cell}) END AS mls,
        CASE WHEN ext = '.TXT' THEN {redact('body', 'ordered')} END AS whole FROM found),
    done AS (SELECT *, {file_text('mls', 'ext', 'whole')} AS masked_text FROM masked)
    """


RUNS = """SELECT doc_id, lang, source, line, text = '' AS empty, unnest(range(len(rs))) AS seg, unnest(rs) AS text
    FROM (SELECT *, list_transform(string_split(text, '. '), lambda s, i: s || CASE WHEN i < len(string_split(text, '. '))
        THEN '. ' ELSE '' END) AS rs FROM ({lines}))""".replace("{lines}", LINES)

WORDS = f"""
    pages AS (SELECT doc_id, line, CAST(line // 8 + 1 AS BIGINT) AS page, string_split(text, ' ') AS ws FROM ({LINES})),
    spread AS (SELECT doc_id, page, line, unnest(range(len(ws))) AS ix, unnest(ws) AS word FROM pages),
    words AS (SELECT doc_id, page, line, word,
        row_number() OVER (PARTITION BY doc_id ORDER BY line, ix) - 1 AS pos
        FROM spread WHERE word <> ''),
    boxed AS (SELECT *, CAST(pos * 10 AS DOUBLE) AS x, CAST(line * 12 AS DOUBLE) AS y,
        CAST(length(word) * 0.5 AS DOUBLE) AS w, CAST(8.0 AS DOUBLE) AS h FROM words)"""

# Phrases are looked up in the list of a page's words, at every place; the few
# phrases that overlap themselves keep a place only if the last one kept is clear.
PHRASES = f"""WITH {detected()}, {WORDS},
    starts AS (SELECT doc_id, array_to_string(list(word ORDER BY pos)[1:3], ' ') AS phrase FROM words GROUP BY doc_id),
    phrases AS (SELECT DISTINCT * FROM (SELECT doc_id, unnest(vals) AS phrase FROM found
        UNION ALL SELECT doc_id, phrase FROM starts)),
    toks AS (SELECT doc_id, phrase, list_filter(string_split(lower(phrase), ' '), lambda t: t <> '') AS toks
        FROM phrases WHERE phrase <> ''),
    page_lists AS (SELECT doc_id, page, min(pos) AS base, list(lower(word) ORDER BY pos) AS ws,
        list(boxed ORDER BY pos) AS bs FROM boxed GROUP BY doc_id, page),
    tried AS (SELECT p.*, t.phrase, t.toks, list_filter(range(1, len(ws) - len(toks) + 2),
        lambda i: ws[i : i + len(toks) - 1] = toks) AS places FROM page_lists p JOIN toks t USING (doc_id)),
    kept AS (SELECT *, list_reduce(places, lambda acc, i: CASE WHEN len(acc) = 0 OR i >= acc[-1] + len(toks)
        THEN list_append(acc, i) ELSE acc END, CAST([] AS BIGINT[])) AS starts FROM tried),
    each AS (SELECT *, unnest(starts) AS i FROM kept),
    sliced AS (SELECT doc_id, phrase, page, base + i - 1 AS start, bs[i : i + len(toks) - 1] AS b FROM each),
    boxes AS (SELECT doc_id, phrase, page, CAST(start AS BIGINT) AS start, b[1].x AS x,
        list_min(list_transform(b, lambda o: o.y)) AS y,
        b[-1].x + b[-1].w - b[1].x AS w,
        list_max(list_transform(b, lambda o: o.y + o.h)) - list_min(list_transform(b, lambda o: o.y)) AS h
        FROM sliced)"""

DICTIONARY = """dict AS (SELECT DISTINCT CASE WHEN contains(text, ',') THEN 'company_name' ELSE 'human_name' END AS kind,
        text AS value FROM benchmark WHERE text <> ''),
    hits AS (SELECT d.doc_id, kind, value, instr(d.text, value) AS ix FROM documents d JOIN dict ON contains(d.text, value)),
    per_doc AS (SELECT doc_id,
        coalesce(list(value ORDER BY ix, value) FILTER (WHERE kind = 'company_name'), []) AS company,
        coalesce(list(value ORDER BY ix, value) FILTER (WHERE kind = 'human_name'), []) AS human
        FROM hits GROUP BY doc_id),
    docs AS (SELECT d.*, coalesce(company, []) AS company, coalesce(human, []) AS human
        FROM documents d LEFT JOIN per_doc USING (doc_id))"""

GAZETTEER = f"""WITH {DICTIONARY} SELECT doc_id, '' AS address, {flat('company')} AS company_name,
    '' AS email_address, {flat('human')} AS human_name, '' AS phone_number FROM docs"""

JOB_COLUMNS = f"""doc_id, {redact('text', 'ordered')} AS masked_text, {MASKED_STATUS} AS status,
    CAST(len(vals) AS BIGINT) AS n_values, {counts()}, CAST(length(text) AS BIGINT) AS text_len"""

MODEL_LISTS = {
    "email_address": emails("text"),
    "phone_number": f"list_filter(regexp_extract_all(text, '{PHONE}'), lambda p: contains(p, '('))",
}
MODEL = "WITH " + detected(lists=MODEL_LISTS)

PROMPT_HEAD = (
    "<|startoftext|><|im_start|>system\nExtract <address>, <company_name>, <email_address>, "
    "<human_name>, <phone_number><|im_end|>\n<|im_start|>user\n"
)
PROMPT_TAIL = "<|im_end|>\n<|im_start|>assistant\n"


def text_list(items):
    return f"SELECT doc_id, {flat(items)} AS items FROM found"


ORACLES = {
    "scan_files": f"""SELECT concat('/c/', source, '/', CASE doc_id % 5 WHEN 1 THEN '.' WHEN 2 THEN '_' ELSE '' END, doc_id, {EXT}) AS path,
        lower({EXT}) AS ext, doc_id % 7 = 3 OR ({EXT} = '.TXT' AND text = '') AS empty, true AS whole FROM documents""",
    "scan_paths": f"""SELECT {path(EXT)} AS path, lower({EXT}) AS ext FROM documents
        UNION ALL SELECT concat('/p/', page_id, '.md'), '.md' FROM pages""",
    "scan_text": f"""SELECT {path("CASE lang WHEN 'de' THEN '.rtf' WHEN 'fr' THEN '.Md' ELSE '.txt' END")} AS path,
        text FROM documents""",
    "docx_segments": f"""SELECT concat('/c/', source, '/', doc_id, '.docx') AS path, CAST(0 AS BIGINT) AS part,
        CAST(line AS BIGINT) AS para, CASE WHEN NOT empty THEN CAST(seg AS BIGINT) END AS seg,
        CASE WHEN NOT empty THEN text END AS text FROM ({RUNS})""",
    "pptx_segments": f"""SELECT concat('/c/', source, '/', doc_id, '.pptx') AS path, CAST(line // 8 + 1 AS BIGINT) AS part,
        CAST(line % 8 AS BIGINT) AS seg, text FROM ({LINES})""",
    "xlsx_cells": f"""SELECT concat('/c/', source, '/', doc_id, '.xlsx') AS path, CAST(1 AS BIGINT) AS sheet,
        CAST(line AS BIGINT) AS cell_ord, CASE WHEN length(text) >= 20 THEN 's' ELSE 'inlineStr' END AS dtype,
        CASE WHEN length(text) >= 20 THEN CAST(line AS VARCHAR) ELSE text END AS raw FROM ({LINES})""",
    "xlsx_shared_strings": f"""SELECT concat('/c/', source, '/', doc_id, '.xlsx') AS path,
        CAST(line AS BIGINT) AS idx, text FROM ({LINES})""",
    "read_any": f"""SELECT {path(EXT)} AS path, {file_text()} AS text, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "documents_source": "SELECT doc_id, text FROM documents",
    "masked_path": "SELECT doc_id, concat('/c/', source, '/', doc_id, '_masked.TXT') AS out_path FROM documents",
    "write_masked_text": f"""{FOUND} SELECT {path("'.TXT'", '_masked')} AS path,
        {redact('text', 'ordered')} AS text FROM found""",
    "write_masked_office": f"""{corpus(OFFICE_EXT)} SELECT {path('ext', '_masked')} AS path,
        masked_text AS text, CAST(NULL AS VARCHAR) AS error FROM done""",
    "passthrough_clean": f"{FOUND} SELECT doc_id, text AS masked_text FROM found WHERE len(vals) = 0",
    "audit_sink": f"""{FOUND} SELECT doc_id, {MASKED_STATUS} AS status, CAST(NULL AS VARCHAR) AS raw,
        CAST(NULL AS VARCHAR) AS error, {counts()}, CAST(length(text) AS BIGINT) AS text_len FROM found""",
    "build_prompt": f"SELECT doc_id, concat('{PROMPT_HEAD}', text, '{PROMPT_TAIL}') AS prompt FROM documents",
    "infer_pii": f"{MODEL} SELECT doc_id, CAST(NULL AS VARCHAR) AS detect_status, {flat_kinds()} FROM found",
    "cut_at_stop": f"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^[{WS}]+', ''), '[{WS}]+$', '') AS answer
        FROM conversations""",
    "extract_json": """WITH raws AS (SELECT conv_id, turn, CASE WHEN role = 'user'
        THEN concat('say {"a": "', text, '"} so } there') ELSE concat('} ', text) END AS r FROM conversations),
        spans AS (SELECT *, instr(r, '{') AS i, length(r) - instr(reverse(r), '}') + 1 AS j FROM raws)
        SELECT conv_id, turn, CASE WHEN i > 0 AND contains(r, '}') AND j > i THEN substr(r, i, j - i + 1)
        ELSE '{}' END AS json FROM spans""",
    "parse_pii": f"""{FOUND}, right_shape AS (SELECT *, lang <> 'fr' AS good FROM found)
        SELECT doc_id, CASE WHEN NOT good THEN 'parse_failed' END AS status, '' AS address, '' AS company_name,
        CASE WHEN good THEN {flat('email_address')} ELSE '' END AS email_address, '' AS human_name,
        CASE WHEN good THEN {flat('phone_number')} ELSE '' END AS phone_number FROM right_shape""",
    "detect_email": f"SELECT doc_id, {flat(emails('text'))} AS email_address FROM documents",
    "detect_phone": f"SELECT doc_id, {flat(phones('text'))} AS phone_number FROM documents",
    "detect_address": f"SELECT doc_id, {flat(addresses('text'))} AS address FROM documents",
    "detect_email_in_pages": f"SELECT page_id, {flat(emails('html'))} AS email_address FROM pages",
    "detect_gazetteer": GAZETTEER,
    "detect_gazetteer_grams": GAZETTEER,
    "entities_all": f"{FOUND} {text_list('items')}",
    "entities_distinct": f"{FOUND} {text_list('vals')}",
    "entities_longest_first": f"{FOUND} {text_list('ordered')}",
    "words_longest_first": f"""WITH spread AS (SELECT doc_id, unnest(range(len(ws))) AS ix, unnest(ws) AS v
        FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS ws FROM documents)),
        firsts AS (SELECT doc_id, v, min(ix) AS ix FROM spread WHERE v <> '' GROUP BY doc_id, v)
        SELECT doc_id, coalesce(string_agg(v, {MARK} ORDER BY -{length16('v')}, ix), '') AS items
        FROM documents LEFT JOIN firsts USING (doc_id) GROUP BY doc_id""",
    "entities_long": f"""{FOUND}, kinds AS ({' UNION ALL '.join(
        f"SELECT doc_id, '{k}' AS kind, {k} AS vs FROM found" for k in KINDS)})
        SELECT doc_id, kind, CAST(unnest(range(len(vs))) AS BIGINT) AS ord, unnest(vs) AS value FROM kinds""",
    "docs_with_pii": f"{FOUND} SELECT doc_id FROM found WHERE len(vals) > 0",
    "docs_without_pii": f"{FOUND} SELECT doc_id FROM found WHERE len(vals) = 0",
    "entity_counts": f"{FOUND} SELECT doc_id, {counts()}, CAST(length(text) AS BIGINT) AS text_len FROM found",
    "entity_counts_from_long": f"{FOUND} SELECT doc_id, {counts()} FROM found WHERE len(items) > 0",
    "corpus_summary": f"""{FOUND}, kinds AS ({' UNION ALL '.join(
        f"SELECT doc_id, '{k}' AS kind, unnest({k}) AS value FROM found" for k in KINDS)})
        SELECT kind, count(*) AS mentions, count(DISTINCT value) AS distinct_values,
        count(DISTINCT doc_id) AS documents FROM kinds GROUP BY kind""",
    "input_counts": "SELECT source, count(*) AS n_inputs FROM documents GROUP BY source",
    "mask_blocks": f"SELECT doc_id, {mask('text')} AS masked FROM documents",
    "replace_literal": f"""WITH firsts AS (SELECT *, regexp_extract(text, '^[^ \n]*') AS v FROM documents)
        SELECT doc_id, CASE WHEN v = '' THEN text ELSE replace(text, v, {mask('v')}) END AS masked FROM firsts""",
    "redact_text": f"{FOUND} SELECT doc_id, {redact('text', 'ordered')} AS masked_text FROM found",
    "mask_cells": f"""{FOUND}, lined AS (SELECT doc_id, ordered, unnest(range(len({_LS}))) AS cell_ord,
        unnest({_LS}) AS text FROM found),
        hit AS (SELECT *, len(list_filter(ordered, lambda p: contains(text, p))) > 0 AS hit FROM lined)
        SELECT doc_id, CAST(cell_ord AS BIGINT) AS cell_ord, CASE WHEN hit THEN '[MASKED]' ELSE text END AS masked_text,
        hit AND text <> '[MASKED]' AS changed FROM hit""",
    "changed_parts": f"""{FOUND}, lined AS (SELECT doc_id, ordered, unnest(range(len({_LS}))) AS line,
        unnest({_LS}) AS text FROM found),
        masked AS (SELECT doc_id, CAST(line // 8 + 1 AS BIGINT) AS part, {redact('text', 'ordered')} <> text AS changed FROM lined)
        SELECT doc_id, part, bool_or(changed) AS changed FROM masked GROUP BY doc_id, part""",
    "redact_any": f"{corpus(EXT)} SELECT {path('ext')} AS path, masked_text FROM done",
    "assemble_docx": f"""SELECT doc_id, string_agg(text || chr(10), '' ORDER BY line) AS text FROM ({LINES}) GROUP BY doc_id""",
    "assemble_pptx": f"""WITH slides AS (SELECT doc_id, line // 8 AS part,
        coalesce(string_agg(text || ' ', '' ORDER BY line) FILTER (WHERE regexp_matches(text, '[^{WS}]')), '') || chr(10) AS text
        FROM ({LINES}) GROUP BY ALL)
        SELECT doc_id, string_agg(text, '' ORDER BY part) AS text FROM slides GROUP BY doc_id""",
    "assemble_xlsx": f"""SELECT doc_id, coalesce(string_agg(text || ' ', '' ORDER BY line)
        FILTER (WHERE regexp_matches(text, '[^{WS}]')), '') AS text FROM ({LINES}) GROUP BY doc_id""",
    "resolve_cells": f"""SELECT concat('/c/', source, '/', doc_id, '.xlsx') AS path, CAST(1 AS BIGINT) AS sheet,
        CAST(line AS BIGINT) AS cell_ord, CASE WHEN length(text) >= 20 THEN 's' ELSE 'inlineStr' END AS dtype,
        CASE WHEN length(text) >= 20 THEN CAST(line AS VARCHAR) ELSE text END AS raw, text,
        CAST(NULL AS VARCHAR) AS status FROM ({LINES})""",
    "resolve_nation_cells": """SELECT 'n.xlsx' AS path, CAST(1 AS BIGINT) AS sheet, CAST(c_custkey AS BIGINT) AS cell_ord,
        's' AS dtype, CAST(idx AS VARCHAR) AS raw, n_name AS text, CASE WHEN n_name IS NULL THEN 'failed' END AS status
        FROM (SELECT *, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS idx FROM customer)
        LEFT JOIN nation ON idx = n_nationkey""",
    "assemble_words": f"""WITH {WORDS}, page_texts AS (SELECT doc_id, page,
        string_agg(word || ' ', '' ORDER BY pos) || chr(10) AS text FROM words GROUP BY doc_id, page)
        SELECT doc_id, string_agg(text, '' ORDER BY page) AS text FROM page_texts GROUP BY doc_id""",
    "phrase_boxes": f"{PHRASES} SELECT * FROM boxes",
    "page_boxes": f"""{PHRASES}, heights AS (SELECT doc_id, CAST(line // 8 + 1 AS BIGINT) AS page, count(*) * 100.0 AS height
        FROM ({LINES}) GROUP BY ALL)
        SELECT doc_id, phrase, page, start, x, CAST(height - y - h AS DOUBLE) AS y, w, h
        FROM boxes JOIN heights USING (doc_id, page) WHERE height = 800.0""",
    "mask_documents": f"{FOUND} SELECT {JOB_COLUMNS} FROM found",
    "mask_documents_by_dictionary": f"""WITH {DICTIONARY}, {detected('docs', lists={
        'address': addresses('text'), 'email_address': emails('text'), 'phone_number': phones('text'),
        'company_name': 'company', 'human_name': 'human'})} SELECT {JOB_COLUMNS} FROM found""",
    "mask_documents_by_model": f"{MODEL} SELECT {JOB_COLUMNS} FROM found",
    "mask_corpus": f"""{corpus(EXT)} SELECT {path('ext', '_masked')} AS path, masked_text AS text,
        CAST(NULL AS VARCHAR) AS error FROM done""",
    "isolate_failures": f"""{corpus(EXT)}, broken AS (SELECT *, source = 'src1' AND ext <> '.TXT' AS cut FROM done)
        SELECT {path('ext')} AS path, CASE WHEN cut THEN 'failed' ELSE {MASKED_STATUS} END AS status,
        CASE WHEN cut THEN 0 ELSE CAST(len(vals) AS BIGINT) END AS n_values,
        CASE WHEN NOT cut THEN CAST(length(text) AS BIGINT) END AS text_len, cut AS has_error FROM broken""",
    "mask_file_stream": f"""{corpus(EXT)} SELECT {path('ext')} AS path, {MASKED_STATUS} AS status,
        CAST(len(vals) AS BIGINT) AS n_values, CAST(length(text) AS BIGINT) AS text_len, masked_text FROM done""",
}

_REDACTED_LINES = f"""{FOUND}, lined AS (SELECT doc_id, ordered, unnest(range(len({_LS}))) AS line,
    unnest({_LS}) AS text FROM found),
    masked AS (SELECT doc_id, CAST(line AS BIGINT) AS line, text, {redact('text', 'ordered')} AS masked_text FROM lined)
    SELECT doc_id, line, masked_text, masked_text <> text AS changed FROM masked"""
ORACLES["redact_segments"] = _REDACTED_LINES
ORACLES["redact_segments_by_list"] = _REDACTED_LINES
# Whole texts: how they are cut must not show.
ORACLES["infer_pii_chunks"] = f"""SELECT doc_id, CAST(NULL AS VARCHAR) AS detect_status, '' AS address, '' AS company_name,
    {flat(first_seen(emails('text')))} AS email_address, '' AS human_name,
    {flat(first_seen(f"list_filter(regexp_extract_all(text, '{PHONE}'), lambda p: contains(p, '('))"))} AS phone_number FROM documents"""
ORACLES["mask_stream"] = ORACLES["mask_documents"]
ORACLES["mask_stream_by_model"] = ORACLES["mask_documents_by_model"]
ORACLES["mask_stream_by_dictionary"] = ORACLES["mask_documents_by_dictionary"]
ORACLES["mask_stream_by_dictionary_in_scan"] = ORACLES["mask_documents_by_dictionary"]
ORACLES["mask_file_stream_to_files"] = ORACLES["mask_corpus"]
ORACLES["unreadable_packages"] = f"""SELECT {path(EXT)} AS path, lower({EXT}) AS ext, true AS has_error
    FROM documents WHERE source = 'src1' AND {EXT} <> '.TXT'"""
