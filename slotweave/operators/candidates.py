"""Form candidates: which cells of a form can be filled, by four rules in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import slots
from slotweave.functions import textfn as X
from slotweave.operators import colocated
from slotweave.operators.tables import TABLE, table_fields

CELL = [*TABLE, "row", "col"]


def address_facts(cells: DataFrame, runs: DataFrame | None, clustered: bool = False) -> DataFrame:
    """A row per cell, label, slot and first run at each address (CELL), with all that the rules ask of the address: one shuffle, by table.

    cells: CELL, col_span, text, has_nested, has_controls; runs: CELL, para, run, text, or None where each cell's text is its only run.
    With `clustered` the rows of a form already lie together, hashed by form_id alone, and only runs with a slot are shuffled. A label
    also counts at the address right of it (behind its span), so no cell is joined with its neighbour. Columns: kind, own
    (of a slot), and of the address n_cells, n_slots, blank (every
    cell), busy (nested tables or controls), open (a blank cell without a nested table), label (the least of the labels left of it),
    placeholder (a unit, where a cell holds a placeholder only), head (the column's first row has text) and first_run (paragraph 0 has a
    run 0).
    """
    no = F.lit(False)
    s = X.strip(F.coalesce("text", F.lit("")))
    blank = F.col("_s") == ""
    is_label = X.stripped_label(F.col("_s"), F.col("_placeholder")) & ~F.col("_s").isin(*X.TOTALS) & ~F.col("has_nested")
    unit = F.when(F.col("_placeholder") & ~F.col("has_nested"), X.placeholder_unit("_s"))
    none = {"label": "string", "unit": "string", "required": "boolean", "insert_offset": "int", "para": "int", "run": "int"}

    def event(kind: int, col: Column, first_run: Column = no, blank: Column = no, busy: Column = no, open: Column = no, titled: Column = no, **own: Column) -> Column:
        flags = {"kind": F.lit(kind).cast("byte"), "col": col, "blank": blank, "busy": busy, "open": open, "titled": titled, "first_run": first_run}
        return F.struct(*[c.alias(k) for k, c in flags.items()], *[own.get(k, F.lit(None).cast(t)).cast(t).alias(k) for k, t in none.items()])

    cell = event(_CELL, F.col("col"), F.lit(runs is None), blank, F.col("has_nested") | F.col("has_controls"), blank & ~F.col("has_nested"), (F.col("row") == 0) & ~blank, unit=unit)
    label = event(_LABEL, F.col("col") + F.col("col_span"), label=F.col("_s"))
    rows = cells.withColumn("_s", s).withColumn("_placeholder", X.stripped_placeholder(F.col("_s"))).select(*TABLE, "row", F.inline(F.when(is_label, F.array(cell, label)).otherwise(F.array(cell))))
    if runs is None:
        runs = cells.select(*CELL, F.lit(0).alias("para"), F.lit(0).alias("run"), "text")
    else:
        rows = rows.unionByName(runs.filter("para = 0 AND run = 0").select(*TABLE, "row", F.inline(F.array(event(_RUN, F.col("col"), F.lit(True))))))
    found = runs.filter(F.col("text").contains(":"))  # runs without a colon skip Python
    found = found.select(*CELL, "para", "run", F.inline(F.pandas_udf(slots.slots_series, slots.SCHEMA)("text")))
    found = found.select(*TABLE, "row", F.inline(F.array(event(_SLOT, F.col("col"), **{k: F.col(k) for k in none}))))
    if clustered:
        rows = rows.unionByName(found.repartition("form_id"))
    else:
        rows = rows.unionByName(found).repartition(*TABLE)

    at = Window.partitionBy(*TABLE, "col", "row")
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    facts = {
        "n_cells": F.count(of(_CELL, F.lit(1))),
        "n_slots": F.count(of(_SLOT, F.lit(1))),
        "blank": F.min(of(_CELL, F.col("blank"))),
        "busy": F.max(of(_CELL, F.col("busy"))),
        "open": F.max("open"),
        "first_run": F.max("first_run"),
        "label": F.min(of(_LABEL, F.col("label"))),
        "placeholder": F.min(of(_CELL, F.col("unit"))),
    }
    own = F.when(F.col("kind") == _SLOT, F.struct(*none)).alias("own")
    rows = rows.select(*CELL, "kind", own, "titled", *[c.over(at).alias(k) for k, c in facts.items()])
    return rows.withColumn("head", F.max("titled").over(Window.partitionBy(*TABLE, "col"))).drop("titled")  # sorted so already


#: Kinds of the rows of address_facts, cells first.
_CELL, _SLOT, _LABEL, _RUN = range(4)


def _first_rule(at: DataFrame) -> DataFrame:
    """The candidates of each address's first rule, in order of precedence; rule 4 may give several.

    1 (right of a label): an empty cell right of a label cell (behind its span); totals and nested tables don't count. 4 (inline
    slots): slots behind `label :` inside a run, each with its insert offset. 2 (under a header): an empty cell under a column whose
    first row has text. 3 (placeholder): a cell that holds a placeholder or unit only; its field is protected.
    """
    cell, slot = F.col("kind") == _CELL, F.col("kind") == _SLOT
    right_of_label = F.col("open") & F.col("label").isNotNull()
    under_header = F.col("open") & (F.col("row") > 0) & F.col("head")
    alone = cell & (F.col("n_slots") == 0)
    rule = F.when(right_of_label, F.when(cell, 1)).when(slot, 4).when(alone & under_header, 2).when(alone & F.col("placeholder").isNotNull(), 3)
    rows = at.withColumn("rule", rule).filter("rule IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(*TABLE, "col", "row").orderBy("kind"))  # several cells of an address give one
    rows = rows.withColumn("_nth", nth).filter((F.col("rule") == 4) | (F.col("_nth") == 1))
    by_rule = lambda r1, r4, r2, r3: F.when(F.col("rule") == 1, r1).when(F.col("rule") == 4, r4).when(F.col("rule") == 2, r2).otherwise(r3)
    none = F.lit("")
    found = {
        "label": by_rule(F.col("label"), F.col("own.label"), none, none),
        "unit": by_rule(X.label_unit("label"), F.col("own.unit"), F.lit("text"), F.col("placeholder")),
        "required": by_rule(X.is_required("label"), F.col("own.required"), F.lit(False), F.lit(False)),
        "insert_offset": F.when(F.col("rule") == 4, F.col("own.insert_offset")),
        "para": F.when(F.col("rule") == 4, F.col("own.para")).otherwise(0),
        "run": F.when(F.col("rule") == 4, F.col("own.run")).otherwise(0),
    }
    return rows.select(*CELL, "n_cells", "blank", "busy", "first_run", "rule", *[c.alias(k) for k, c in found.items()])


def resolve_candidates(cells: DataFrame, runs: DataFrame | None, clustered: bool = False) -> DataFrame:
    """All rules' candidates, of each cell those of its first rule."""
    return _first_rule(address_facts(cells, runs, clustered)).select(*CELL, "rule", "label", "unit", "required", "insert_offset", "para", "run")


def with_field_id(fields: DataFrame) -> DataFrame:
    """field_id: a hash of the form and the field's place, the same in every run."""
    text = lambda c, other="null": F.coalesce(F.col(c).cast("string"), F.lit(other))
    place = F.concat_ws("|", *map(text, CELL), text("para", "0"), text("run", "0"), text("insert_offset", "-1"))
    return fields.withColumn("field_id", F.concat(F.lit("f-"), F.substring(F.sha2(place, 256), 1, 24)))


def form_fields(cells: DataFrame, runs: DataFrame | None, clustered: bool = False) -> DataFrame:
    """The forms' fields, from detection to editability, after one shuffle by table (none if clustered: see address_facts).

    editable and reason, the first that fails: one cell at the address, no placeholder, plain text only, empty unless
    rule 4, a run there.
    """
    reason = (
        F.when(F.col("n_cells") != 1, "address")
        .when(F.col("rule") == 3, "placeholder")
        .when(F.col("busy"), "controls")
        .when((F.col("rule") != 4) & ~F.col("blank"), "not empty")
        .when((F.col("rule") != 4) & ~F.col("first_run"), "no run")
    )
    rows = with_field_id(_first_rule(address_facts(cells, runs, clustered)))
    return rows.withColumn("reason", reason).withColumn("editable", F.col("reason").isNull()).drop("n_cells", "blank", "busy", "first_run")


def classify_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """status of each paragraph (text, has_controls) and whether it can be edited."""
    status = X.paragraph_status("text", F.col("has_controls"))
    return paragraphs.withColumn("status", status).withColumn("editable", F.col("status") == "normal")


def split_composite(fields: DataFrame) -> DataFrame:
    """Fields whose text is several values with `/` between become numbered fields; part tells the number, 0 for a whole."""
    several = F.col("original_text").contains("/") & (F.coalesce("label", F.lit("")) != "")
    parts = F.when(several, F.transform(F.split("original_text", "/"), X.strip)).otherwise(F.array("original_text"))
    rows = fields.select("*", F.posexplode(parts).alias("_i", "_part"), several.alias("_several")).filter(~F.col("_several") | (F.col("_part") != ""))
    label = F.when(F.col("_several"), F.format_string("%s #%d", "label", F.col("_i") + 1)).otherwise(F.col("label"))
    part = F.when(F.col("_several"), F.col("_i") + 1).otherwise(0)
    return rows.withColumns({"label": label, "original_text": F.col("_part"), "part": part}).drop("_i", "_part", "_several")


_TIMES = r"(시작\s*시각)\s*(\d{1,2}시\s*\d{2}분)\s*부터\s*(종료\s*시각)\s*(\d{1,2}시\s*\d{2}분)\s*까지"


def _compound(c: Column) -> Column:
    """Parts of a compound value: `/` pairs, a time range in four, or parts between commas; one part if it is none."""
    clean = lambda a: F.filter(F.transform(a, X.strip), lambda x: x != "")
    times = F.array(*[X.strip(F.regexp_extract(c, _TIMES, i)) for i in range(1, 5)])
    return F.when(c.contains("/"), clean(F.split(c, "/"))).when(c.rlike(_TIMES), times).when(c.contains(","), clean(F.split(c, r"[/,]\s*"))).otherwise(F.array(c))


def split_compound_slots(fields: DataFrame) -> DataFrame:
    """Editable fields whose text holds several slots become one field each, with status; part and subpart number them.

    A unit alone or a blank bullet is decoration. `label: value` gives label and value, other compounds their parts, and
    a part that is a compound itself is split once more.
    """
    text, label = F.coalesce("original_text", F.lit("")), X.strip(F.coalesce("label", F.lit("")))
    s = X.strip(text)
    unit_only = (s != "") & ((F.lower(s) == F.lower(F.coalesce("unit", F.lit("")))) | F.lower(label).isin("단위", "단위:", "단위 :") | X.is_unit_like(s))
    bullet = (s == "") & F.lower(F.concat_ws(" ", F.coalesce("context", F.array().cast("array<string>")))).rlike(r"bullet|•|-|\*|글머리|항목")
    decoration = unit_only | bullet
    ends = label.rlike(r":\s*$")
    pair = text.rlike(r"^[^:]+:\s*\S")
    after = X.strip(F.regexp_extract(text, r"(?s)^[^:]+:\s*(.*)$", 1))
    labelled = F.when(ends, F.array(F.col("label"), F.when(text.rlike("^[^:]+:"), after).otherwise(text))).otherwise(F.array(X.strip(F.regexp_extract(text, r"^([^:]+):", 1)), after))
    compound = text.contains("/") | text.rlike(r"부터.*까지|\d{1,2}:\d{2}\s*[-~]\s*\d{1,2}:\d{2}|총사업비.*보조금|보조금.*총사업비")
    editable = F.coalesce("editable", F.lit(False))
    parts = F.when(editable & ~decoration & (s != "") & (ends | pair), labelled).when(editable & ~decoration & compound, _compound(text)).otherwise(F.array(text))
    rows = fields.withColumns({"_parts": parts, "_decoration": decoration, "_editable": editable}).withColumn("_several", F.size("_parts") > 1)
    rows = rows.select("*", F.posexplode("_parts").alias("_i", "_part"))
    subs = F.when(F.col("_several"), _compound(F.col("_part"))).otherwise(F.array("_part"))
    rows = rows.select("*", F.posexplode(subs).alias("_j", "_text")).filter(~F.col("_several") | (X.strip("_text") != ""))
    n = F.col("_i") + 1
    name = F.when(~F.col("_several"), F.col("label")).when(F.coalesce("label", F.lit("")) != "", F.format_string("%s #%d", "label", n)).otherwise(F.substring(X.strip("_text"), 1, 40))
    status = F.when(~F.col("_editable"), F.col("status")).when(F.col("_decoration"), "decoration").otherwise(X.slot_status("_text"))
    out = rows.withColumns({"part": F.when(F.col("_several"), n).otherwise(0), "subpart": F.col("_j"), "label": name, "status": status, "original_text": F.col("_text")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def build_fields(paragraphs: DataFrame, cells: DataFrame, clustered: bool = False) -> DataFrame:
    """(form_id, no, label, original_text, origin): editable paragraphs, then table value fields, numbered per form."""
    text = classify_paragraphs(paragraphs).filter("editable").select("form_id", F.lit("paragraph").alias("origin"), F.lit(0).alias("table_idx"), F.col("seq").alias("row"), F.lit(0).alias("col"), F.substring(X.strip("text"), 1, 40).alias("label"), F.col("text").alias("original_text"))
    values = table_fields(cells, clustered).select("form_id", F.lit("table").alias("origin"), "table_idx", "row", "col", "label", "original_text")
    number = F.row_number().over(Window.partitionBy("form_id").orderBy("origin", "table_idx", "row", "col", "original_text"))
    return text.unionByName(values).withColumn("no", number).select("form_id", "no", "label", "original_text", "origin")


def public_fields(fields: DataFrame) -> DataFrame:
    """What a client sees of a field: its place by structure only."""
    return fields.select("form_id", "field_id", "label", F.when(F.col("unit") != "text", F.col("unit")).alias("unit"), "editable", "required", F.when(F.col("editable"), "normal").otherwise("blocked").alias("status"), F.struct("section", "table_idx", "row", "col", "para").alias("location"))


def form_profile(fields: DataFrame) -> DataFrame:
    """Per form the number of fields by rule, editable and protected ones, and a warning when some are protected."""
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    out = fields.groupBy("form_id").agg(F.count("*").alias("n_fields"), *[count(F.col("rule") == r).alias(f"n_rule{r}") for r in (1, 4, 2, 3)], count(F.col("editable")).alias("n_editable"), count(~F.col("editable")).alias("n_protected"))
    return out.withColumn("warning", F.when(F.col("n_protected") > 0, F.format_string("%d protected", "n_protected")))


def correct_candidates(fields: DataFrame, corrections: DataFrame, clustered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fields, problems): corrections (form_id, field_id, label, enabled) on editable fields; others are problems.

    With `clustered` both are already dealt by form_id, and nothing is shuffled.
    """
    key = ["form_id", "field_id"]
    fix = corrections.select("form_id", "field_id", F.col("label").alias("new_label"), "enabled")
    # A correction whose field is there in several rows is usable if one of them is editable, else a problem for each row.
    found = colocated.left_join(corrections, fields.groupBy(*key).agg(F.max("editable").alias("usable"), F.count("*").alias("n")), key, clustered)
    problems = found.filter(~F.coalesce("usable", F.lit(False))).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1)).cast("long"))))
    problems = problems.select(*key, F.when(F.col("n").isNotNull(), "protected").otherwise("unknown").alias("type"))
    rows = colocated.left_join(fields, fix, key, clustered)
    label = F.when(F.col("editable") & ~X.is_blank("new_label"), X.strip("new_label")).otherwise(F.col("label"))
    rows = rows.withColumns({"label": label, "editable": F.col("editable") & F.coalesce("enabled", F.lit(True))})
    return rows.drop("new_label", "enabled"), problems


