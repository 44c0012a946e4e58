"""One query per operator, each over a whole given table."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_checks import derived as d
from maskwright.functions import answers, detect, entities, text
from maskwright.operators import assembly, boxes, cells, entities as entity_ops, gazetteer, inference, masking
from maskwright.plans import detectors
from maskwright.plans.mask_corpus import mask_corpus, mask_folder, redact_any
from maskwright.plans.mask_documents import detect_values, mask_documents, outcome, passthrough_clean
from maskwright.schema import FAILED, KINDS
from maskwright.session import durable, work_path
from maskwright.sources import files, office, sinks
from maskwright.sources.tables import spread_small
from maskwright.streaming.mask_stream import (
    mask_document_batches, mask_document_stream, mask_file_stream, mask_files_to_files,
)

LIST_MARK = "\x1f"


def flat(df):
    """Lists as marked strings and ints as longs, so that rows compare anywhere."""
    out = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col, LIST_MARK)
        elif isinstance(field.dataType, T.IntegerType):
            col = col.cast("long")
        out.append(col.alias(field.name))
    return df.select(*out)


def pii_columns(df, *keep):
    return df.select(*keep, *[F.col("pii")[k].alias(k) for k in KINDS])


def pattern_model(stop, context_tokens, max_new_tokens):
    """A stand-in for a model: answers with what two patterns find, in the loose
    form models answer in."""
    import re

    email, phone = re.compile(detect.EMAIL), re.compile(detect.PHONE)

    def answer(prompt):
        body = prompt[len(answers.PROMPT_HEAD) : -len(answers.PROMPT_TAIL)]
        phones = [p for p in phone.findall(body) if "(" in p]
        found = json.dumps({"EMAIL_ADDRESS": email.findall(body), "phone_number": phones})
        return f"Here you are: {found[:-1]},}}{stop[0]} and more"

    return lambda prompts: [answer(p) for p in prompts]


# sources and sinks


def scan_files(spark, sf):
    """A fifth of the names begin with a dot, a fifth with a low line, and a seventh of the files are empty."""
    sign = F.when(F.col("doc_id") % 5 == 1, ".").when(F.col("doc_id") % 5 == 2, "_").otherwise("")
    rows = d.file_rows(spark, sf).select(
        F.concat(F.regexp_extract("path", "^.*/", 0), sign, F.regexp_extract("path", "[^/]+$", 0)).alias("path"),
        F.when(F.col("doc_id") % 7 == 3, F.unhex(F.lit(""))).otherwise(F.col("content")).alias("content"))
    html = d.table(spark, sf, "pages").select(
        F.concat(F.lit("/c/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    root = d.folder(spark, rows.unionByName(html))
    found = files.scan_files(spark, root)
    return found.select(d.below(root).alias("path"), "ext", (F.col("length") == 0).alias("empty"),
                        (F.length("content") == F.col("length")).alias("whole"))


def scan_paths(spark, sf):
    docs = d.folder(spark, d.file_rows(spark, sf).select("path", "content"))
    pages = d.table(spark, sf, "pages").select(
        F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    other = d.folder(spark, pages)
    found = files.scan_paths(spark, [docs, "", " ", f"{docs}/missing", other])
    return found.select(F.regexp_extract("path", "(/[cp]/[^.]*[.][A-Za-z]+)$", 1).alias("path"), "ext")


def scan_text(spark, sf):
    lang, body = F.col("lang"), F.col("text")
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(body, charset))
    content = (
        F.when(lang == "de", marked("FFFE", "UTF-16LE"))
        .when(lang == "fr", marked("FEFF", "UTF-16BE"))
        .when(lang == "es", marked("EFBBBF", "UTF-8"))
        .otherwise(F.encode(body, "UTF-8"))
    )
    ext = F.when(lang == "de", ".rtf").when(lang == "fr", ".Md").otherwise(".txt")
    docs = d.documents(spark, sf, "lang", "source")
    root = d.folder(spark, docs.select(d.doc_path(ext).alias("path"), content.alias("content")))
    return files.scan_text(spark, [root]).select(d.below(root).alias("path"), "text")


def docx_segments(spark, sf):
    return flat(office.docx_segments(d.file_rows(spark, sf, ".docx")).drop("node"))


def pptx_segments(spark, sf):
    return flat(office.pptx_segments(d.file_rows(spark, sf, ".pptx")).drop("node", "para"))


def xlsx_cells(spark, sf):
    found, _ = office.xlsx_cells(d.file_rows(spark, sf, ".xlsx"))
    return flat(found.drop("has_sst"))


def xlsx_shared_strings(spark, sf):
    _, sst = office.xlsx_cells(d.file_rows(spark, sf, ".xlsx"))
    return flat(sst)


def _cut_short(rows):
    """The office files of one source are cut short."""
    broken = (F.col("source") == "src1") & (F.col("ext") != ".txt")
    return rows.withColumn("content", F.when(broken, F.substring("content", 1, 100)).otherwise(F.col("content")))


def unreadable_packages(spark, sf):
    found = office.unreadable_packages(_cut_short(d.file_rows(spark, sf)))
    return found.select("path", "ext", (F.length("error") > 0).alias("has_error"))


def read_any(spark, sf):
    return files.read_any(d.file_rows(spark, sf)).select("path", "text", "error")


def documents_source(spark, sf):
    return d.documents(spark, sf)


def masked_path(spark, sf):
    docs = d.documents(spark, sf, "source")
    return docs.select("doc_id", text.masked_path(d.doc_path(F.lit(".TXT"))).alias("out_path"))


def write_masked_text(spark, sf):
    found = d.detected(spark, sf, "source")
    masked = masking.redact_documents(found).withColumn("path", d.doc_path(F.lit(".TXT")))
    root = work_path(spark, "masked")
    sinks.write_masked_text(masked, root, work_path(spark, "report"))
    return files.scan_text(spark, [root]).select(d.below(root).alias("path"), "text")


def write_masked_office(spark, sf):
    lang = F.col("lang")
    kinds = F.when(lang == "fr", ".pptx").when(lang == "es", ".xlsx").otherwise(".docx")
    masked = mask_corpus(d.file_rows(spark, sf, kinds)).select(
        F.col("out_path").alias("path"), "ext", "status",
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.length("masked_content").cast("long").alias("length"),
        F.col("masked_content").alias("content"),
    )
    again = files.read_any(durable(spark, masked, "packages"))
    return again.select("path", "text", "error")


def passthrough(spark, sf):
    return passthrough_clean(d.documents(spark, sf))


def audit_sink(spark, sf):
    found = d.detected(spark, sf).withColumn("status", outcome())
    path = work_path(spark, "audit")
    sinks.write_audit(sinks.audit(found), path)
    return spark.read.parquet(path)


# detection


def build_prompt(spark, sf):
    return d.documents(spark, sf).select("doc_id", answers.build_prompt(F.col("text")).alias("prompt"))


def infer_pii(spark, sf):
    found = inference.infer_pii(d.documents(spark, sf), pattern_model)
    return flat(pii_columns(found, "doc_id", "detect_status"))


def infer_pii_chunks(spark, sf, size=2000, overlap=200, reach=0):
    found = inference.infer_pii(
        d.documents(spark, sf), pattern_model, batch_size=512, chunk_chars=size, overlap_chars=overlap, reach_chars=reach
    )
    return flat(pii_columns(found, "doc_id", "detect_status"))


def _turns(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def cut_at_stop(spark, sf):
    marks = F.when(F.col("role") == "user", "<|endoftext|>").otherwise("<|im_end|>")
    raw = F.concat(F.lit(" 　"), "text", F.lit("\n"), marks, "text", F.lit("<|im_end|><|endoftext|>"))
    return _turns(spark, sf).select("conv_id", "turn", answers.cut_at_stop(raw).alias("answer"))


def extract_json(spark, sf):
    raw = F.when(F.col("role") == "user", F.concat(F.lit('say {"a": "'), "text", F.lit('"} so } there')))
    raw = raw.otherwise(F.concat(F.lit("} "), "text"))
    return _turns(spark, sf).select("conv_id", "turn", answers.extract_json(raw).alias("json"))


def parse_pii(spark, sf):
    """Answers made of what the rules find, with loose keys and commas; a wrong
    shape in one language."""
    found = d.detected(spark, sf, "lang")
    listed = lambda kind: F.to_json(F.col("pii")[kind])
    raw = F.concat(
        F.lit('ok {"Email_Address": '), listed("email_address"),
        F.lit(', "PHONE_NUMBER" :'), listed("phone_number"),
        F.lit(', "other": {"x": [1,]}, "address":'), 
        F.when(F.col("lang") == "fr", '"z"').otherwise("null"), F.lit(" ,} <|im_end|>"),
    )
    read = found.select("doc_id", answers.read_answer(raw).alias("r")).select("doc_id", "r.pii", "r.status")
    return flat(pii_columns(read, "doc_id", "status"))


def _detector(rule, name):
    def query(spark, sf):
        return flat(d.documents(spark, sf).select("doc_id", rule(F.col("text")).alias(name)))

    return query


def _page_emails(spark, sf):
    pages = spread_small(spark, d.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return flat(pages.select("page_id", detect.detect_email(F.col("html")).alias("email_address")))


def _gazetteer(**options):
    def query(spark, sf):
        found = gazetteer.detect_gazetteer(
            d.documents(spark, sf), d.dictionary(spark, sf), **options
        )
        return flat(pii_columns(found, "doc_id"))

    return query


# entity lists


def entities_all(spark, sf):
    found = d.detected(spark, sf)
    return flat(found.select("doc_id", entities.entities_all(F.col("pii")).alias("items")))


def entities_distinct(spark, sf):
    found = d.detected(spark, sf)
    items = entities.entities_distinct(entities.entities_all(F.col("pii")))
    return flat(found.select("doc_id", items.alias("items")))


def entities_longest_first(spark, sf):
    found = d.detected(spark, sf)
    return flat(found.select("doc_id", entities.entities_longest_first(F.col("values")).alias("items")))


def words_longest_first(spark, sf):
    """The same order on long lists with many ties: the words of every document."""
    words = entities.entities_distinct(F.split("text", "[ \n]"))
    return flat(d.documents(spark, sf).select("doc_id", entities.entities_longest_first(words).alias("items")))


def entities_long(spark, sf):
    return flat(entity_ops.entities_long(d.detected(spark, sf)))


def docs_with_pii(spark, sf):
    return entity_ops.docs_with_pii(d.detected(spark, sf)).select("doc_id")


def docs_without_pii(spark, sf):
    return entity_ops.docs_without_pii(d.detected(spark, sf)).select("doc_id")


def entity_counts(spark, sf):
    return entity_ops.entity_counts(d.detected(spark, sf))


def entity_counts_from_long(spark, sf):
    return entity_ops.entity_counts_from_long(entity_ops.entities_long(d.detected(spark, sf)))


def corpus_summary(spark, sf):
    return entity_ops.corpus_summary(entity_ops.entities_long(d.detected(spark, sf)))


def input_counts(spark, sf):
    return entity_ops.input_counts(d.table(spark, sf, "documents"), "source")


# masking


def mask_blocks(spark, sf):
    return d.documents(spark, sf).select("doc_id", text.mask_blocks(F.col("text")).alias("masked"))


def replace_literal(spark, sf):
    first = F.split("text", "[ \n]")[0]
    return d.documents(spark, sf).select(
        "doc_id", text.replace_literal(F.col("text"), first).alias("masked")
    )


def redact_text(spark, sf):
    return masking.redact_documents(d.detected(spark, sf)).select("doc_id", "masked_text")


def redact_segments(spark, sf):
    rows = d.lines(d.detected(spark, sf), "values")
    return flat(masking.redact_segments(rows).select("doc_id", "line", "masked_text", "changed"))


def redact_segments_by_list(spark, sf):
    rows = d.lines(d.documents(spark, sf))
    lists = d.detected(spark, sf).select("doc_id", "values")
    masked = masking.redact_segments_by_list(rows, lists, "doc_id", ["line"])
    return flat(masked.select("doc_id", "line", "masked_text", "changed"))


def _cells(spark, sf):
    return d.lines(d.detected(spark, sf), "values").withColumnRenamed("line", "cell_ord")


def mask_cells(spark, sf):
    return flat(masking.mask_cells(_cells(spark, sf)).select("doc_id", "cell_ord", "masked_text", "changed"))


def changed_parts(spark, sf):
    rows = d.pptx_rows(d.detected(spark, sf), "values")
    return flat(masking.changed_parts(masking.redact_segments(rows), ["doc_id", "part"]))


def redact_any_query(spark, sf):
    read = detect_values(files.read_any(d.file_rows(spark, sf)))
    return redact_any(read).select("path", "masked_text")


# text assembly and cell lookup


def assemble_docx(spark, sf):
    return assembly.assemble_docx(d.docx_rows(d.documents(spark, sf)), "doc_id")


def assemble_pptx(spark, sf):
    return assembly.assemble_pptx(d.pptx_rows(d.documents(spark, sf)), "doc_id")


def assemble_xlsx(spark, sf):
    rows = d.lines(d.documents(spark, sf)).select(
        "doc_id", F.lit(1).alias("sheet"), F.col("line").alias("cell_ord"), "text"
    )
    return assembly.assemble_xlsx(rows, "doc_id")


def resolve_cells(spark, sf):
    docs = d.documents(spark, sf, "source")
    path = d.doc_path(F.lit(".xlsx")).alias("path")
    found = d.cell_rows(docs, "source").select(path, "sheet", "cell_ord", "dtype", "raw")
    strings = d.lines(docs, "source").select(path, F.col("line").alias("idx"), "text")
    return flat(cells.resolve_cells(found, strings))


def resolve_nation_cells(spark, sf):
    """Customers' nations as shared strings of one workbook, all with one key; every tenth points
    past the table."""
    nation = d.table(spark, sf, "nation").select(
        F.lit("n.xlsx").alias("path"), F.col("n_nationkey").alias("idx"), F.col("n_name").alias("text")
    )
    found = d.table(spark, sf, "customer").select(
        F.lit("n.xlsx").alias("path"), F.lit(1).alias("sheet"), F.col("c_custkey").alias("cell_ord"),
        F.lit("s").alias("dtype"),
        (F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0)).cast("string").alias("raw"),
        F.lit(True).alias("has_sst"),
    )
    return flat(cells.resolve_cells(found, nation))


# positioned words


def assemble_words(spark, sf):
    return assembly.assemble_words(d.word_rows(d.documents(spark, sf)))


def _phrases(spark, sf):
    """Per document: the values found in it, and its first three words."""
    start = F.concat_ws(" ", F.slice(F.filter(F.split("text", "[ \n]"), lambda w: F.length(w) > 0), 1, 3))
    phrases = F.array_union("values", F.array(start))
    return d.detected(spark, sf).select("doc_id", F.explode(phrases).alias("phrase"))


def phrase_boxes(spark, sf):
    found = boxes.phrase_boxes(d.word_rows(d.documents(spark, sf)), _phrases(spark, sf))
    return flat(found)


def page_boxes(spark, sf):
    """Boxes on even pages only have a page to be drawn on."""
    docs = d.documents(spark, sf)
    found = boxes.phrase_boxes(d.word_rows(docs), _phrases(spark, sf))
    dims = d.pptx_rows(docs).groupBy("doc_id", F.col("part").alias("page")).agg(
        (F.count(F.lit(1)) * 100.0).alias("height")
    )
    return flat(boxes.page_boxes(found, dims.filter(F.col("height") == 100.0 * d.SLIDE_LINES)))


# whole jobs


def mask_documents_query(spark, sf):
    return mask_documents(d.documents(spark, sf))


def mask_documents_by_dictionary(spark, sf):
    both = detectors.combined(detectors.by_rules(), detectors.by_dictionary(d.dictionary(spark, sf)))
    return mask_documents(d.documents(spark, sf), both)


def mask_documents_by_model(spark, sf):
    return mask_documents(d.documents(spark, sf), detectors.by_model(pattern_model))


def mask_corpus_query(spark, sf):
    """Documents as a folder of files, masked into another folder, and read again."""
    source = d.folder(spark, d.file_rows(spark, sf).select("path", "content"))
    target = work_path(spark, "masked")
    mask_folder(spark, source, target, work_path(spark, "report"))
    again = files.read_any(files.scan_files(spark, target))
    return again.select(d.below(target).alias("path"), "text", "error")


def isolate_failures(spark, sf):
    out = mask_corpus(_cut_short(d.file_rows(spark, sf)))
    return out.select("path", "status", "n_values", "text_len", (F.col("status") == FAILED).alias("has_error"))


def _arriving(spark, sf):
    """The documents as a stream, whether their table is one file or a folder of files. A stream takes
    a path without glob signs for a folder, so the name is a pattern that only it matches."""
    schema = d.table(spark, sf, "documents").select("doc_id", "text").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")


def mask_stream(spark, sf):
    arriving = _arriving(spark, sf)
    sink = work_path(spark, "stream")
    mask_document_stream(arriving, sink, work_path(spark, "stream-log")).awaitTermination()
    return spark.read.parquet(sink)


def _mask_batches(spark, sf, detect):
    sink = work_path(spark, "stream")
    mask_document_batches(_arriving(spark, sf), sink, work_path(spark, "stream-log"), detect=detect).awaitTermination()
    return spark.read.parquet(sink).drop("batch")


def mask_stream_by_model(spark, sf):
    return _mask_batches(spark, sf, detectors.by_model(pattern_model))


def mask_stream_by_dictionary(spark, sf):
    by_grams = detectors.by_dictionary(d.dictionary(spark, sf), values_bytes=0)
    return _mask_batches(spark, sf, detectors.combined(detectors.by_rules(), by_grams))


def mask_stream_by_dictionary_in_scan(spark, sf):
    """A dictionary that fits into the tasks needs no batches: the stream is one narrow plan."""
    both = detectors.combined(detectors.by_rules(), detectors.by_dictionary(d.dictionary(spark, sf)))
    sink = work_path(spark, "stream")
    mask_document_stream(_arriving(spark, sf), sink, work_path(spark, "stream-log"), detect=both).awaitTermination()
    return spark.read.parquet(sink)


def mask_file_stream_to_files(spark, sf):
    source = d.folder(spark, d.file_rows(spark, sf).select("path", "content"))
    target = work_path(spark, "masked")
    mask_files_to_files(
        files.scan_stream(spark, source), target, work_path(spark, "report"), work_path(spark, "stream-log"), base=source
    ).awaitTermination()
    again = files.read_any(files.scan_files(spark, target))
    return again.select(d.below(target).alias("path"), "text", "error")


def mask_file_stream_query(spark, sf):
    root = d.folder(spark, d.file_rows(spark, sf).select("path", "content"))
    sink = work_path(spark, "stream")
    mask_file_stream(files.scan_stream(spark, root), sink, work_path(spark, "stream-log")).awaitTermination()
    return spark.read.parquet(sink).select(
        d.below(root).alias("path"), "status", "n_values", "text_len", "masked_text"
    )


QUERIES = {
    "scan_files": scan_files,
    "scan_paths": scan_paths,
    "scan_text": scan_text,
    "docx_segments": docx_segments,
    "pptx_segments": pptx_segments,
    "xlsx_cells": xlsx_cells,
    "xlsx_shared_strings": xlsx_shared_strings,
    "unreadable_packages": unreadable_packages,
    "read_any": read_any,
    "documents_source": documents_source,
    "masked_path": masked_path,
    "write_masked_text": write_masked_text,
    "write_masked_office": write_masked_office,
    "passthrough_clean": passthrough,
    "audit_sink": audit_sink,
    "build_prompt": build_prompt,
    "infer_pii": infer_pii,
    "infer_pii_chunks": infer_pii_chunks,
    "cut_at_stop": cut_at_stop,
    "extract_json": extract_json,
    "parse_pii": parse_pii,
    "detect_email": _detector(detect.detect_email, "email_address"),
    "detect_phone": _detector(detect.detect_phone, "phone_number"),
    "detect_address": _detector(detect.detect_address, "address"),
    "detect_email_in_pages": _page_emails,
    "detect_gazetteer": _gazetteer(),
    "detect_gazetteer_grams": _gazetteer(values_bytes=0),
    "entities_all": entities_all,
    "entities_distinct": entities_distinct,
    "entities_longest_first": entities_longest_first,
    "words_longest_first": words_longest_first,
    "entities_long": entities_long,
    "docs_with_pii": docs_with_pii,
    "docs_without_pii": docs_without_pii,
    "entity_counts": entity_counts,
    "entity_counts_from_long": entity_counts_from_long,
    "corpus_summary": corpus_summary,
    "input_counts": input_counts,
    "mask_blocks": mask_blocks,
    "replace_literal": replace_literal,
    "redact_text": redact_text,
    "redact_segments": redact_segments,
    "redact_segments_by_list": redact_segments_by_list,
    "mask_cells": mask_cells,
    "changed_parts": changed_parts,
    "redact_any": redact_any_query,
    "assemble_docx": assemble_docx,
    "assemble_pptx": assemble_pptx,
    "assemble_xlsx": assemble_xlsx,
    "resolve_cells": resolve_cells,
    "resolve_nation_cells": resolve_nation_cells,
    "assemble_words": assemble_words,
    "phrase_boxes": phrase_boxes,
    "page_boxes": page_boxes,
    "mask_documents": mask_documents_query,
    "mask_documents_by_dictionary": mask_documents_by_dictionary,
    "mask_documents_by_model": mask_documents_by_model,
    "mask_corpus": mask_corpus_query,
    "isolate_failures": isolate_failures,
    "mask_stream": mask_stream,
    "mask_stream_by_model": mask_stream_by_model,
    "mask_stream_by_dictionary": mask_stream_by_dictionary,
    "mask_stream_by_dictionary_in_scan": mask_stream_by_dictionary_in_scan,
    "mask_file_stream": mask_file_stream_query,
    "mask_file_stream_to_files": mask_file_stream_to_files,
}
