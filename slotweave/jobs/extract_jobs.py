"""Queries of extraction, linking and evidence over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.jobs import adapters as A
from slotweave.operators import evidence, extract, link
from slotweave.sources import store
from slotweave.sources import text as sources


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def e01_doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_doc_hash(documents(spark, sf_dir)).select("doc_id", "doc_hash")


def e02_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.with_block_id(extract.with_offsets(extract.line_blocks(documents(spark, sf_dir))))
    return rows.select("doc_id", "seq", "block_id", "start", "end", "text")


def e05_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.blocks_of(A.order_sources(spark, sf_dir))
    return rows.select("doc_id", "seq", "level", "heading", "t_row", "t_col", "header", "is_header", F.array_join("context", ";").alias("context"))


def e12_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.explode_facts(extract.line_blocks(documents(spark, sf_dir)), "doc_id", "seq").select("doc_id", "seq", "fact_pos", "fact", "label", "norm", "value")


def e15_paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    return extract.paragraph_blocks(rows).select("doc_id", "seq", "start", "end")


def e16_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("cell_id"), F.col("turn").alias("seq"), "text")
    return extract.own_text(rows).select("doc_id", "cell_id", "text")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.split_long_blocks(extract.with_block_id(extract.line_blocks(documents(spark, sf_dir))))


def e17_split_long_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", "seq", "part_index", "part_count", F.octet_length("text").alias("n_bytes"))


def e18_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_doc_hash(extract.rejoin(_parts(spark, sf_dir))).select("doc_id", "doc_hash")


def e19_extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 11 == 0, "pdf").otherwise("txt"))
    return extract.extract_status(docs, extract.line_blocks(docs.filter("kind = 'txt'")))


def e20_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = extract.with_block_id(extract.line_blocks(A.order_sources(spark, sf_dir)))
    norms = blocks.filter("seq % 2 = 1").select("doc_id", "block_id", X.norm_label("text").alias("norm_text"))
    return extract.with_norm_text(blocks, norms).select("doc_id", "seq", "text", "search_text")


def s1_read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    name = F.concat("source", F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".hwpx", ".pdf", ""))), (F.col("doc_id") % 5 + 1).cast("int")))
    told = F.when(F.col("doc_id") % 4 == 0, "paste").when(F.col("doc_id") % 4 == 1, "exe").otherwise("")
    return sources.with_kind(rows.withColumns({"path": name, "told": told}), "told", "path").select("doc_id", "path", "kind", "error")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the orders' documents, rendered once."""
    return store.stored(extract.with_block_id(extract.line_blocks(A.order_sources(spark, sf_dir))), "order-blocks")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = extract.with_block_id(extract.line_blocks(A.order_sources(spark, sf_dir)))
    return link.link_labels(A.job_fields(spark, sf_dir), blocks)


def r01_link_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("job_id", "field_id", "seq", "quote", "value")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.resolve_links(A.job_fields(spark, sf_dir), _matches(spark, sf_dir))


def r08_resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("job_id", "field_id", "status", "value", "value_transform", F.size("source_block_ids").alias("n_blocks"), "evidence_quote", F.array_join("alternatives", "|").alias("alternatives"), "needs_review")


def r10_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("form_id", F.substring_index("field_id", "-", 1))
    return link.link_summary(rows, "form_id")


def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Proposals that repeat the suggested values, with one fault for each remainder of the order's key."""
    fields, blocks = A.job_fields(spark, sf_dir), order_blocks(spark, sf_dir)
    results = store.stored(link.resolve_links(fields, link.link_labels(fields, blocks)), "results")
    rows = results.filter("status = 'suggested'").withColumn("k", F.substring("job_id", 3, 20).cast("bigint"))
    k = F.col("k")
    rows = rows.select(
        "job_id",
        F.substring_index("field_id", "-", -1).cast("int").alias("proposal_seq"),
        F.when(k % 8 == 3, "zz").otherwise(F.col("field_id")).alias("field_id"),
        F.when(k % 8 == 1, F.concat("value", F.lit("0"))).otherwise(F.col("value")).alias("value"),
        "value_transform",
        F.when(k % 8 == 2, F.concat("source_block_ids", F.array(F.lit("b-none")))).when(k % 8 == 5, F.array().cast("array<string>")).otherwise(F.col("source_block_ids")).alias("source_block_ids"),
        F.when(k % 8 == 0, F.concat("evidence_quote", F.lit("!"))).otherwise(F.col("evidence_quote")).alias("evidence_quote"),
        F.array(F.struct(F.get("source_block_ids", F.lit(0)).alias("block_id"), F.when(k % 8 == 4, "altered").otherwise(F.col("evidence_quote")).alias("quote"))).alias("evidence"),
    )
    edits = rows.filter(F.substring("job_id", 3, 20).cast("bigint") % 8 == 6).select("job_id", "field_id", F.lit("mine").alias("value"), F.lit(1).alias("edit_seq"))
    return rows, fields, results, blocks, edits


def v01_validate_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, _ = evidence.validate_proposals(*_proposals(spark, sf_dir))
    return checked


def v09_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, problems = evidence.validate_proposals(*_proposals(spark, sf_dir))
    return problems


def v10_accept_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fields, _, blocks, _ = _proposals(spark, sf_dir)
    return evidence.accept_proposals(rows, fields, blocks).select("job_id", "proposal_seq", "field_id", "accepted")


def v02_unsettled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value proposed for every field whose rule result is a conflict or missing."""
    _, fields, results, blocks, edits = _proposals(spark, sf_dir)
    none = F.array().cast("array<string>")
    rows = results.filter("status <> 'suggested'").select("job_id", F.substring_index("field_id", "-", -1).cast("int").alias("proposal_seq"), "field_id", F.lit("x").alias("value"), F.lit("extract").alias("value_transform"), none.alias("source_block_ids"), F.lit(None).cast("string").alias("evidence_quote"), F.array().cast("array<struct<block_id:string,quote:string>>").alias("evidence"))
    return evidence.validate_proposals(rows, fields, results, blocks, edits.filter("false"))[0]


def v07_unclear_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted values whose proposal cites nothing, the rule's blocks being gone for some orders."""
    rows, fields, results, blocks, edits = _proposals(spark, sf_dir)
    gone = F.substring("job_id", 3, 20).cast("bigint") % 2 == 0
    rows = results.filter("value_transform = 'unit'").select("job_id", F.substring_index("field_id", "-", -1).cast("int").alias("proposal_seq"), "field_id", "value", "value_transform", F.array().cast("array<string>").alias("source_block_ids"), F.lit(None).cast("string").alias("evidence_quote"), F.array().cast("array<struct<block_id:string,quote:string>>").alias("evidence"))
    results = results.withColumn("source_block_ids", F.when(gone, F.array(F.lit("b-none"))).otherwise(F.col("source_block_ids")))
    return evidence.validate_proposals(rows, fields, results, blocks, edits.filter("false"))[1]


QUERIES = {f.__name__: f for f in (v02_unsettled_results, v07_unclear_units, e01_doc_hash, e02_line_blocks, e05_markdown_blocks, e12_facts, e15_paragraph_blocks, e16_own_text, e17_split_long_blocks, e18_rejoin, e19_extract_status, e20_norm_text, s1_read_sources, r01_link_labels, r08_resolve_links, r10_link_summary, v01_validate_proposals, v09_problems, v10_accept_proposals)}

# SQL ------------------------------------------------------------------------------------------------------

ORDER_DOCS = r"""
grid AS (
  SELECT l_orderkey AS k, string_agg('| ' || CAST(l_linenumber AS VARCHAR) || ' | p\|' || CAST(l_partkey AS VARCHAR) || ' | ' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS rws
  FROM lineitem GROUP BY 1
), docs AS (
  SELECT 'o-' || o_orderkey AS doc_id, o_orderkey AS k, concat_ws(chr(10), '# Order ' || o_orderkey,
    'Customer: ' || coalesce(c_name, '?') || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', Status: ' || o_orderstatus END || '; Total: ' || CAST(trunc(o_totalprice) AS BIGINT),
    '금액: ' || CAST(trunc(o_totalprice) AS BIGINT) || '천원', 'Date ' || strftime(o_orderdate, '%Y-%m-%d'),
    CASE WHEN o_orderkey % 7 = 0 THEN 'status: X' ELSE '' END, '## Lines', '| Line | Part | Qty |', '|---|:--|--:|', coalesce(rws, ''), 'Priority: ' || o_orderpriority) AS text
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN grid ON grid.k = o_orderkey
), lines AS (
  SELECT doc_id, k, sha256(text) AS doc_hash, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS seq, unnest(parts) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM docs)
)"""

_DOCUMENT_LINES = r"""
lines AS (
  SELECT doc_id, sha256(whole) AS doc_hash, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS seq, unnest(parts) AS text
  FROM (SELECT doc_id, text AS whole, string_split(text, chr(10)) AS parts FROM documents WHERE text <> '')
)"""

_BLOCK_ID = "'b-' || substr(sha256(doc_hash || ':' || seq), 1, 24)"

_FORM_FIELDS = """
form_fields(form_id, field_id, label, unit, editable) AS (VALUES ('f0','f0-1','Customer',NULL,true),('f0','f0-2','Status',NULL,true),('f0','f0-3','금액','천원',true),('f0','f0-4','Date',NULL,true),
 ('f1','f1-1','customer',NULL,true),('f1','f1-2','Total',NULL,true),('f1','f1-3','Clerk',NULL,true),('f1','f1-4','',NULL,true),('f2','f2-1','STATUS',NULL,true),('f2','f2-2','금액',NULL,true),('f2','f2-3','Priority',NULL,false)
), job_fields AS (SELECT 'j-' || o_orderkey AS job_id, o_orderkey AS k, 'o-' || o_orderkey AS doc_id, f.* FROM orders JOIN form_fields f ON f.form_id = 'f' || (o_orderkey % 3))"""


def _label_value(fact: str) -> str:
    return rf"""CASE WHEN instr({fact}, ':') > 0 THEN trim(split_part({fact}, ':', 1)) ELSE regexp_extract(trim({fact}), '^(\S*)', 1) END AS label,
 CASE WHEN instr({fact}, ':') > 0 THEN trim(substr({fact}, instr({fact}, ':') + 1)) ELSE regexp_extract(trim({fact}), '(?s)^\S+\s+(.*)$', 1) END AS value"""


_MATCHES = rf"""
parts AS (
  SELECT doc_id, k, seq, {_BLOCK_ID} AS block_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, unnest(f) AS quote
  FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '\s*[,;/]\s*'), lambda x: trim(x)), lambda x: x <> '') AS f FROM lines)
  UNION ALL SELECT doc_id, k, seq, {_BLOCK_ID}, 1073741824, text FROM lines
), facts AS (SELECT *, regexp_replace(lower(label), '[^\p{{L}}\p{{N}}_]', '', 'g') AS norm FROM (SELECT *, {_label_value('quote')} FROM parts)
), firsts AS (SELECT * FROM facts WHERE norm <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, seq, norm ORDER BY pos) = 1
), matches AS (
  SELECT j.job_id, j.field_id, f.seq, f.block_id, f.quote, f.value FROM job_fields j JOIN firsts f ON f.doc_id = j.doc_id AND f.norm = regexp_replace(lower(j.label), '[^\p{{L}}\p{{N}}_]', '', 'g')
)"""

_RESULTS = r"""
grouped AS (
  SELECT job_id, field_id, count(DISTINCT value) AS n, list(block_id ORDER BY seq) AS ids, list(value ORDER BY seq) AS vals, arg_min(value, seq) AS v, arg_min(quote, seq) AS q FROM matches GROUP BY 1, 2
), results AS (
  SELECT j.job_id, j.k, j.doc_id, j.field_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'suggested' ELSE 'conflict' END AS status,
    CASE WHEN n = 1 THEN CASE WHEN unit = '천원' AND regexp_matches(q, '[\d,]+\s*천원') THEN CAST(CAST(replace(regexp_extract(q, '([\d,]+)\s*천원', 1), ',', '') AS HUGEINT) * 1000 AS VARCHAR) ELSE v END END AS value,
    CASE WHEN n = 1 THEN CASE WHEN unit = '천원' AND regexp_matches(q, '[\d,]+\s*천원') THEN 'unit' ELSE 'extract' END ELSE 'none' END AS value_transform,
    coalesce(ids, []) AS ids, CASE WHEN n = 1 THEN q END AS evidence_quote, CASE WHEN n > 1 THEN array_to_string(vals, '|') END AS alternatives, n IS NOT NULL AS needs_review
  FROM job_fields j LEFT JOIN grouped g ON g.job_id = j.job_id AND g.field_id = j.field_id
)"""

_LINKED = f"WITH {ORDER_DOCS}, {_FORM_FIELDS}, {_MATCHES}, {_RESULTS}"

_PROPOSALS = r"""
proposals AS (
  SELECT job_id, k, doc_id, CAST(split_part(field_id, '-', 2) AS INTEGER) AS proposal_seq, CASE WHEN k % 8 = 3 THEN 'zz' ELSE field_id END AS field_id,
    CASE WHEN k % 8 = 1 THEN value || '0' ELSE value END AS value, value AS r_value, value_transform, CASE WHEN k % 8 = 2 THEN list_append(ids, 'b-none') WHEN k % 8 = 5 THEN [] ELSE ids END AS ids,
    CASE WHEN k % 8 = 0 THEN evidence_quote || '!' ELSE evidence_quote END AS quote, ids[1] AS e_id, CASE WHEN k % 8 = 4 THEN 'altered' ELSE evidence_quote END AS e_quote
  FROM results WHERE status = 'suggested'
)"""

#: The checks by their rules, over the proposals, fields, results, blocks and edits as they stand.
_CHECKS = rf"""
blocks AS (SELECT doc_id, {_BLOCK_ID} AS block_id, text FROM lines
), edits AS (SELECT job_id, field_id, 'mine' AS user_value FROM proposals WHERE k % 8 = 6
), cited AS (
  SELECT p.job_id, p.proposal_seq, bool_and(b.block_id IS NOT NULL) AS all_there, list_sort(list(DISTINCT p.id) FILTER (b.block_id IS NULL)) AS gone_ids, bool_or(coalesce(contains(b.text, coalesce(p.quote, '')), false)) AS held
  FROM (SELECT *, unnest(ids) AS id FROM proposals) p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND b.block_id = p.id GROUP BY 1, 2
), listed AS (
  SELECT p.job_id, p.proposal_seq, coalesce(contains(b.text, p.e_quote), false) AS list_held, b.block_id IS NOT NULL AS list_there
  FROM proposals p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND b.block_id = p.e_id WHERE coalesce(p.e_id, '') <> '' AND coalesce(p.e_quote, '') <> ''
), loose AS (SELECT DISTINCT p.job_id, p.proposal_seq FROM proposals p JOIN blocks b ON b.doc_id = p.doc_id WHERE len(p.ids) = 0 AND contains(b.text, p.quote)
), ruled AS (SELECT DISTINCT r.job_id, r.field_id FROM (SELECT *, unnest(ids) AS id FROM results) r JOIN blocks b ON b.doc_id = r.doc_id AND b.block_id = r.id
), facts_of AS (
  SELECT p.*, f.field_id IS NULL AS unknown, r.field_id IS NULL AS no_result, len(p.ids) > 0 AND NOT coalesce(c.all_there, true) AS gone, c.gone_ids,
    coalesce(p.quote, '') <> '' AND NOT CASE WHEN len(p.ids) > 0 THEN coalesce(c.held, false) ELSE o.job_id IS NOT NULL END AS no_quote,
    r.status <> 'suggested' AS unsettled, NOT coalesce(l.list_held, true) AS altered, coalesce(r.status = 'suggested' AND p.value <> r.value, false) AS differs, r.value AS rule_value,
    p.value_transform = 'unit' AND u.job_id IS NULL AND NOT coalesce(l.list_there, false) AS unclear, e.user_value, coalesce(e.user_value <> p.value, false) AS kept_back
  FROM proposals p LEFT JOIN job_fields f ON f.job_id = p.job_id AND f.field_id = p.field_id LEFT JOIN results r ON r.job_id = p.job_id AND r.field_id = p.field_id LEFT JOIN edits e ON e.job_id = p.job_id AND e.field_id = p.field_id
  LEFT JOIN cited c ON c.job_id = p.job_id AND c.proposal_seq = p.proposal_seq LEFT JOIN listed l ON l.job_id = p.job_id AND l.proposal_seq = p.proposal_seq LEFT JOIN loose o ON o.job_id = p.job_id AND o.proposal_seq = p.proposal_seq
  LEFT JOIN ruled u ON u.job_id = p.job_id AND u.field_id = p.field_id
), checks AS (SELECT *, unknown OR no_result OR gone OR no_quote AS stopped FROM facts_of)"""

ORACLE_SQL = {
    "e01_doc_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS doc_hash FROM documents",
    "e02_line_blocks": f"""WITH {_DOCUMENT_LINES} SELECT doc_id, seq, {_BLOCK_ID} AS block_id, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", text
FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS e FROM lines)""",
    "e05_markdown_blocks": rf"""WITH {ORDER_DOCS}, a AS (
  SELECT doc_id, seq, text, nullif(length(regexp_extract(text, '^(#{{1,6}})\s*(.+)$', 1)), 0) AS level, starts_with(text, '|') AND ends_with(text, '|') AS is_row,
    list_transform(string_split(regexp_replace(regexp_replace(replace(text, '\|', chr(1)), '^\|', ''), '\|$', ''), '|'), lambda x: replace(trim(x), chr(1), '\|')) AS cells FROM lines
), b AS (SELECT *, is_row AND regexp_matches(text, '^[|:\- ]+$') AS is_sep, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM a
), c AS (SELECT *, lag(is_sep) OVER w AS after_sep, lag(is_row) OVER (PARTITION BY doc_id ORDER BY seq) AS after_row, CASE WHEN is_sep THEN array_to_string(lag(cells) OVER w, '|') END AS title, lag(len(cells)) OVER w AS n_before FROM b WINDOW w AS (PARTITION BY doc_id, island ORDER BY seq)
), d AS (SELECT *, CASE WHEN is_row AND NOT is_sep AND NOT coalesce(after_sep, false) THEN 1 ELSE 0 END AS adds, is_row AND coalesce(after_row, false) AS inside FROM c
), e AS (
  SELECT doc_id, seq, CAST(level AS INTEGER) AS level, CAST(coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS INTEGER) AS heading,
    CASE WHEN inside THEN CAST(sum(adds) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) END AS t_row, CASE WHEN inside THEN CAST(CASE WHEN after_sep THEN 0 ELSE n_before - 1 END AS INTEGER) END AS t_col,
    CASE WHEN inside THEN coalesce(last_value(title IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS header, CASE WHEN inside THEN after_sep END AS is_header
  FROM d WINDOW w AS (PARTITION BY doc_id, island ORDER BY seq)
) SELECT *, concat_ws(';', 'h' || heading, 'row=' || t_row, 'col=' || t_col, CASE WHEN header <> '' THEN 'header=' || header END) AS context FROM e""",
    "e12_facts": rf"""WITH {_DOCUMENT_LINES}, p AS (
  SELECT doc_id, seq, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS fact_pos, unnest(f) AS fact
  FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '\s*[,;/]\s*'), lambda x: trim(x)), lambda x: x <> '') AS f FROM lines)
) SELECT doc_id, seq, fact_pos, fact, label, value, regexp_replace(lower(label), '[^\p{{L}}\p{{N}}_]', '', 'g') AS norm FROM (SELECT *, {_label_value('fact')} FROM p)""",
    "e15_paragraph_blocks": r"""SELECT doc_id, seq, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (
  SELECT conv_id AS doc_id, turn AS seq, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations WHERE trim(coalesce(text, '')) <> '')""",
    "e16_own_text": "SELECT conv_id AS doc_id, role AS cell_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY 1, 2",
    "e18_rejoin": "SELECT doc_id, sha256(text) AS doc_hash FROM documents WHERE text <> ''",
    "e19_extract_status": f"""WITH {_DOCUMENT_LINES}, n AS (SELECT doc_id, count(*) AS n, max(strlen(text)) AS longest FROM lines GROUP BY 1), s AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'unsupported' WHEN text IS NULL THEN 'failed' WHEN n IS NULL THEN 'empty' WHEN longest > 6000 THEN 'partial' ELSE 'extracted' END AS status, n FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
) SELECT doc_id, status, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS n_blocks,
  CASE status WHEN 'unsupported' THEN 'unknown kind' WHEN 'partial' THEN 'a block is over the size limit' ELSE '' END AS warning FROM s""",
    "e20_norm_text": rf"WITH {ORDER_DOCS} SELECT doc_id, seq, text, CASE WHEN seq % 2 = 1 THEN regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '', 'g') ELSE text END AS search_text FROM lines",
    "s1_read_sources": r"""WITH n AS (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.hwpx' WHEN 3 THEN '.pdf' ELSE '' END AS path,
  CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN NULL ELSE CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'hwpx' END END AS kind FROM documents)
SELECT doc_id, path, kind, CASE WHEN kind IS NULL THEN 'UNKNOWN_KIND' END AS error FROM n""",
    "r01_link_labels": f"{_LINKED} SELECT job_id, field_id, seq, quote, value FROM matches",
    "r08_resolve_links": f"{_LINKED} SELECT job_id, field_id, status, value, value_transform, CAST(len(ids) AS INTEGER) AS n_blocks, evidence_quote, alternatives, needs_review FROM results",
    "r10_link_summary": f"""{_LINKED}, c AS (SELECT split_part(field_id, '-', 1) AS form_id, status FROM results)
SELECT form_id, count(*) AS n_fields, count(*) FILTER (status = 'suggested') AS n_suggested, count(*) FILTER (status = 'conflict') AS n_conflict, count(*) FILTER (status = 'missing') AS n_missing,
  CAST(count(*) FILTER (status = 'suggested') AS DOUBLE) / count(*) AS fill_rate FROM c GROUP BY ROLLUP (form_id)""",
    "e17_split_long_blocks": """WITH RECURSIVE l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS seq, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> '')
), chars AS (SELECT doc_id, seq, i, CAST(sum(strlen(c)) OVER (PARTITION BY doc_id, seq ORDER BY i) AS BIGINT) AS upto FROM (SELECT doc_id, seq, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM (SELECT doc_id, seq, string_split(t, '') AS x FROM l WHERE strlen(t) > 6000))
), ends AS (SELECT doc_id, seq, list(upto ORDER BY upto) AS ends FROM chars GROUP BY 1, 2
), cuts AS (
  SELECT doc_id, seq, ends, 0 AS part_index, CAST(0 AS BIGINT) AS low, list_max(list_filter(ends, lambda e: e <= 6000)) AS high FROM ends
  UNION ALL SELECT doc_id, seq, ends, part_index + 1, high, list_max(list_filter(ends, lambda e: e <= high + 6000)) FROM cuts WHERE high < list_max(ends))
SELECT doc_id, seq, part_index, CAST(count(*) OVER (PARTITION BY doc_id, seq) AS INTEGER) AS part_count, CAST(high - low AS INTEGER) AS n_bytes FROM cuts
UNION ALL SELECT doc_id, seq, 0, 1, CAST(strlen(t) AS INTEGER) FROM l WHERE strlen(t) <= 6000""",
    "v01_validate_proposals": f"""{_LINKED}, {_PROPOSALS}, {_CHECKS} SELECT job_id, proposal_seq, field_id, CASE WHEN stopped THEN 'blocked' WHEN kept_back THEN 'ok' WHEN unsettled OR altered OR differs OR unclear THEN 'blocked' ELSE 'ok' END AS status,
  CASE WHEN unknown THEN 'unknown field' WHEN no_result THEN 'no rule result' WHEN gone THEN 'cited block missing' WHEN no_quote THEN 'quote not found' WHEN kept_back THEN 'user value protected' WHEN unclear THEN 'unit unclear' WHEN differs THEN 'value differs' WHEN altered THEN 'evidence altered' WHEN unsettled THEN 'rule result unsettled' END AS reason FROM checks""",
    "v09_problems": f"""{_LINKED}, {_PROPOSALS}, {_CHECKS}, found AS (
  SELECT *, 'invalid_field_id' AS type, 'error' AS severity, NULL::VARCHAR AS detail FROM checks WHERE unknown OR no_result
  UNION ALL SELECT *, 'missing_quote', 'error', unnest(gone_ids) FROM checks WHERE NOT unknown AND NOT no_result AND gone
  UNION ALL SELECT *, 'missing_quote', 'error', NULL FROM checks WHERE NOT unknown AND NOT no_result AND NOT gone AND no_quote
  UNION ALL SELECT *, 'missing_quote', 'error', NULL FROM checks WHERE NOT stopped AND altered UNION ALL SELECT *, 'value_mismatch', 'error', rule_value FROM checks WHERE NOT stopped AND differs
  UNION ALL SELECT *, 'unit_unclear', 'warning', NULL FROM checks WHERE NOT stopped AND unclear UNION ALL SELECT *, 'user_value_protected', 'error', user_value FROM checks WHERE NOT stopped AND kept_back)
SELECT job_id, proposal_seq, field_id, type, severity, detail FROM found""",
    "v02_unsettled_results": f"{_LINKED} SELECT job_id, CAST(split_part(field_id, '-', 2) AS INTEGER) AS proposal_seq, field_id, 'blocked' AS status, 'rule result unsettled' AS reason FROM results WHERE status <> 'suggested'",
    "v07_unclear_units": f"{_LINKED} SELECT job_id, CAST(split_part(field_id, '-', 2) AS INTEGER) AS proposal_seq, field_id, 'unit_unclear' AS type, 'warning' AS severity, NULL::VARCHAR AS detail FROM results WHERE value_transform = 'unit' AND k % 2 = 0",
    "v10_accept_proposals": rf"""{_LINKED}, {_PROPOSALS}, n AS (SELECT *, count(*) OVER (PARTITION BY job_id, field_id) AS n FROM proposals)
SELECT job_id, proposal_seq, field_id, k % 8 NOT IN (0, 2, 3, 5) AND n = 1 AND field_id <> 'f2-3' AND value <> '' AND contains(quote, value) AS accepted FROM n""",
}
