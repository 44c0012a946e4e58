"""Entity kinds and the row shapes shared by all operators."""

from pyspark.sql import types as T

# The five entity kinds, in the order their lists are concatenated.
KINDS = ["address", "company_name", "email_address", "human_name", "phone_number"]

# The file types that are read and masked.
TEXT_EXTENSIONS = [".txt", ".md", ".rtf"]
OFFICE_EXTENSIONS = [".docx", ".pptx", ".xlsx"]
SUPPORTED_EXTENSIONS = OFFICE_EXTENSIONS + TEXT_EXTENSIONS

# Outcome of one document.
MASKED = "masked"
PARTLY_MASKED = "partly_masked"
CLEAN = "clean"
PARSE_FAILED = "parse_failed"
FAILED = "failed"

PII_TYPE = T.StructType([T.StructField(kind, T.ArrayType(T.StringType())) for kind in KINDS])

# One text node of an office package. `node` numbers the text nodes of a part;
# `last` marks the final row of a paragraph (docx) or slide (pptx). A paragraph
# or slide without text is one row whose `seg`, `node` and `text` are null.
SEGMENT_ITEM = "struct<part:int,para:int,seg:int,node:int,text:string,last:boolean>"
# One cell of a workbook: `raw` is its inner text before shared strings are resolved.
CELL_ITEM = "struct<sheet:int,cell_ord:int,dtype:string,raw:string>"
