"""Fixed schemas of the tables that helpers and tests build."""

from pyspark.sql import types as T

SOURCES = "doc_id string, kind string, text string"
POSITION = "struct<table_id:string,row:int,col:int>"
BLOCKS = f"doc_id string, seq int, block_id string, text string, context array<string>, table_position {POSITION}, facts array<string>"
FIELDS = "form_id string, field_id string, label string, original_text string, context array<string>, unit string, editable boolean, required boolean, row int, col int"
JOBS = "job_id string, form_id string, doc_id string"
PROPOSALS = "job_id string, proposal_seq int, field_id string, value string, value_transform string, source_block_ids array<string>, evidence_quote string, evidence array<struct<block_id:string,quote:string>>"
CELLS = "form_id string, section string, table_idx int, row int, col int, row_span int, col_span int, text string, has_nested boolean, has_controls boolean"
RUNS = "form_id string, section string, table_idx int, row int, col int, para int, run int, text string"
EDITS = "job_id string, edit_seq int, field_id string, value string, selected boolean, origin string"
ENTRIES = "form_id string, pos int, path string, method int, size long, crc_ok boolean, encrypted boolean, sha256 string, content binary, error string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
