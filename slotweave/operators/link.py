"""Rule linking: fields to source facts and table cells by equal meaning, with evidence for every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.operators.tables import TABLE, col_labels
from slotweave.sources import store

#: Labels that mean the same column (fixed pairs), by their normalised form.
SYNONYMS = {"품명": "항목", "이름": "성명"}


def canonical(label: Column | str) -> Column:
    """The normalised label, synonyms mapped to one of them."""
    n = X.norm_label(label)
    out = n
    for a, b in SYNONYMS.items():
        out = F.when(n == a, b).otherwise(out)
    return out


def in_scope(field_title: str, field_section: str, block_title: str, block_section: str) -> Column:
    """A field with a table title or section takes only blocks of the same."""
    same = lambda f, b: F.col(f).isNull() | (F.col(f) == F.col(b))
    return F.coalesce(same(field_title, block_title) & same(field_section, block_section), F.lit(False))


#: What stands before the colon of a context entry that names a table's title or a section (fixed words).
MARKS = {"title": "표", "section": "구역"}


def scope_of(context: Column | str, mark: str) -> Column:
    """What follows the first context entry that begins with mark and a colon (`표` for a title, `구역` for a section)."""
    found = F.get(F.filter(X._c(context), lambda x: x.startswith(f"{mark}:")), F.lit(0))
    return X.strip(F.substr(found, F.lit(len(mark) + 2)))


def link_labels(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, field_id, seq, block_id, quote, value): blocks that name a field and give it a value.

    fields: job_id, doc_id, field_id, label, and perhaps title and section; blocks: doc_id, seq, block_id, text,
    and perhaps title, section and search_text. Where title or section is absent and context (array) is not, they are
    taken from its entries (see scope_of). Per block the first matching fact counts, else the whole text as one
    label and value. Fields with an empty label match nothing. The join is on (doc_id, normalised label).
    """
    wanted = fields.withColumn("norm", X.norm_label("label")).filter(F.col("norm") != "")
    for c in ("title", "section"):
        wanted, blocks = (df if c in df.columns else df.withColumn(c, scope_of("context", MARKS[c]) if "context" in df.columns else F.lit(None).cast("string")) for df in (wanted, blocks))
    text = F.col("search_text") if "search_text" in blocks.columns else F.col("text")
    part = lambda whole: lambda q: F.struct(F.lit(whole).alias("whole"), q.alias("q"))
    every = F.concat(F.transform(F.split("text", "[,;/]", -1), part(False)), F.array(part(True)(text)))
    own = ["doc_id", "seq", "block_id", "b_title", "b_section"]
    rows = blocks.select("doc_id", "seq", "block_id", F.col("title").alias("b_title"), F.col("section").alias("b_section"), F.posexplode(every).alias("pos", "e")).select(*own, "pos", "e.whole", "e.q")
    # Label and value are read from the part as it stands: on a stripped one each would strip it again wherever it is used.
    colon = F.instr("q", ":") > 0
    label = F.when(colon, F.substring_index("q", ":", 1)).otherwise(F.regexp_extract("q", f"^{X.SPACE}*({X.NON_SPACE}*)", 1))
    value = F.when(colon, X.strip(F.substr("q", F.instr("q", ":") + 1))).otherwise(F.regexp_extract("q", f"(?s)^{X.SPACE}*{X.NON_SPACE}+{X.SPACE}+(.*?){X.SPACE}*$", 1))
    rows = rows.withColumn("norm", F.regexp_replace(F.lower(label), X.NON_WORD, ""))
    # Facts that no field asks for go before anything is shuffled; the labels asked for are broadcast if they are few.
    rows = rows.join(store.small(wanted.select("norm").distinct(), "labels"), "norm", "left_semi").withColumn("value", value).filter("value <> ''")
    rows = rows.withColumn("quote", F.when(F.col("whole"), F.col("q")).otherwise(X.strip("q")))
    first = rows.repartition("doc_id", "norm").groupBy(*own, "norm").agg(F.min(F.struct("pos", "quote", "value")).alias("f"))
    found = wanted.join(first, ["doc_id", "norm"]).filter(in_scope("title", "section", "b_title", "b_section"))
    return found.select("job_id", "field_id", "seq", "block_id", "f.quote", "f.value")


def source_cells(cells: DataFrame, scopes: DataFrame) -> DataFrame:
    """Cells of zipped sources as link_table_cells takes them.

    cells: form_id (the document), section (its part), table_idx, row, col, col_span, text; scopes: form_id, part,
    table_idx, title and section, as table_scopes finds them. A column's label is the text of the table's first row
    over the columns that it spans; rows count from the one below. A table without a title and section is left out by the
    linker.
    """
    labels = col_labels(cells)
    top = F.min("row").over(Window.partitionBy(*TABLE))
    rows = cells.withColumn("_top", top).filter(F.col("row") > F.col("_top")).join(labels, [*TABLE, "col"], "left")
    rows = rows.withColumnRenamed("section", "part").join(scopes, ["form_id", "part", "table_idx"], "left")
    place = F.concat_ws("/", "part", "table_idx", "row", "col")
    block = F.concat(F.lit("b-"), F.substring(F.sha2(F.concat_ws(":", "form_id", place), 256), 1, 24))
    table_id = F.concat_ws(":", "part", F.col("table_idx").cast("string"))
    seq = F.col("table_idx") * F.lit(1 << 40) + F.shiftleft(F.col("row").cast("long"), 20) + F.col("col")
    return rows.select(F.col("form_id").alias("doc_id"), "title", "section", table_id.alias("table_id"), seq.alias("seq"), block.alias("block_id"), (F.col("row") - F.col("_top")).alias("row"), "col", "col_label", "text")


def link_table_cells(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """(job_id, field_id, seq, block_id, quote, value): source cells that answer a field by place and meaning.

    fields: job_id, doc_id, field_id, label, title, section, row, col, fixed_row (the label names a row of the form's
    table); cells: doc_id, title, section, table_id, seq, block_id, row, col, col_label, text. A field without a title
    or section is not matched this way, nor one whose scope holds several source tables. With a fixed row the value
    stands in the row of the cell whose text is the label, at the field's column; else the column has the label's
    meaning wherever it stands, in the field's row if it has one.
    """
    scoped = fields.filter(F.col("title").isNotNull() | F.col("section").isNotNull())
    tables = cells.select("doc_id", F.col("title").alias("b_title"), F.col("section").alias("b_section"), F.coalesce("table_id", F.lit("∅")).alias("t")).distinct()
    one = scoped.join(tables, "doc_id").filter(in_scope("title", "section", "b_title", "b_section"))
    one = one.groupBy("job_id", "field_id").agg(F.countDistinct("t").alias("n")).filter("n = 1").drop("n")
    scoped = scoped.join(one, ["job_id", "field_id"]).withColumnsRenamed({"row": "f_row", "col": "f_col"})
    source = cells.withColumnsRenamed({"title": "b_title", "section": "b_section"}).filter(~X.is_blank("text"))
    scope = in_scope("title", "section", "b_title", "b_section")

    meant = scoped.filter(~F.col("fixed_row")).withColumn("meaning", canonical("label")).join(source.withColumn("meaning", canonical("col_label")), ["doc_id", "meaning"])
    meant = meant.filter(scope & (F.col("f_row").isNull() | (F.col("f_row") == F.col("row"))))

    named = source.select("doc_id", F.col("b_title").alias("n_title"), F.col("b_section").alias("n_section"), F.col("table_id").alias("n_table"), F.col("row").alias("n_row"), X.norm_label("text").alias("norm")).distinct()
    fixed = scoped.filter("fixed_row").withColumn("norm", X.norm_label("label")).join(named, ["doc_id", "norm"])
    place = [fixed.doc_id == source.doc_id, F.col("n_table").eqNullSafe(source.table_id), F.col("n_row") == source.row, F.col("n_title").eqNullSafe(source.b_title), F.col("n_section").eqNullSafe(source.b_section), F.col("f_col") == source.col]
    fixed = fixed.join(source.withColumnRenamed("doc_id", "s_doc"), [F.col("doc_id") == F.col("s_doc"), *place[1:]]).filter(scope)
    out = ["job_id", "field_id", "seq", "block_id", F.col("text").alias("quote"), X.strip("text").alias("value")]
    return meant.select(*out).unionByName(fixed.select(*out)).distinct()


def resolve_links(fields: DataFrame, matches: DataFrame) -> DataFrame:
    """Per field of a job: status, value, value_transform, source_block_ids, evidence_quote, alternatives, needs_review.

    No match is missing, one distinct value suggested, several a conflict with the values as alternatives in the
    order of their blocks. A suggested value is multiplied by 1000 if the field's unit is 천원 and the first quote
    says so.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "block_id", "quote", "value")))  # matches of one field in one document
    found = matches.groupBy("job_id", "field_id").agg(order.alias("m"))
    rows = fields.select("job_id", "field_id", "label", "unit").join(found, ["job_id", "field_id"], "left")
    values = F.array_distinct(F.transform("m", lambda x: x["value"]))
    rows = rows.withColumn("values", F.coalesce(values, F.array().cast("array<string>"))).withColumn("first", F.get("m", F.lit(0)))
    converted = F.when(F.lower(X.strip("unit")) == "천원", X.thousand_to_unit("first.quote"))
    one = F.size("values") == 1
    status = F.when(F.size("values") == 0, "missing").when(one, "suggested").otherwise("conflict")
    return rows.select(
        "job_id",
        "field_id",
        status.alias("status"),
        F.when(one, F.coalesce(converted, F.get("values", F.lit(0)))).alias("value"),
        F.when(one, F.when(converted.isNotNull(), "unit").otherwise("extract")).otherwise("none").alias("value_transform"),
        F.coalesce(F.transform("m", lambda x: x["block_id"]), F.array().cast("array<string>")).alias("source_block_ids"),
        F.when(one, F.col("first.quote")).alias("evidence_quote"),
        F.when(F.size("values") > 1, F.transform("m", lambda x: x["value"])).alias("alternatives"),
        (F.size("values") > 0).alias("needs_review"),
    )


def link_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of the statuses by the given columns, and over all (nulls)."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    out = results.rollup(*by).agg(F.count("*").alias("n_fields"), *[count(s).alias(f"n_{s}") for s in ("suggested", "conflict", "missing")])
    return out.withColumn("fill_rate", F.col("n_suggested") / F.col("n_fields"))
