"""Applying edits to form runs, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.operators import colocated

RUN = ["form_id", "section", "table_idx", "row", "col", "para", "run"]
_LONG = 30


def selected_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, conflicts): selected edits with a value; a job with several for one field is rejected as a whole."""
    chosen = edits.filter(F.col("selected") & (F.coalesce("value", F.lit("")) != ""))
    conflicts = chosen.groupBy("job_id", "field_id").agg(F.count("*").alias("n")).filter("n > 1")
    return chosen.join(conflicts.select("job_id").distinct(), "job_id", "left_anti"), conflicts


def latest_edits(log: DataFrame) -> DataFrame:
    """The last choice per field of an edit log."""
    last = F.max_by(F.struct("value", "selected", "origin", "edit_seq"), "edit_seq").alias("e")
    return log.groupBy("job_id", "field_id").agg(last).select("job_id", "field_id", "e.*")


def edits_as_of(log: DataFrame, snapshots: DataFrame, width: int) -> DataFrame:
    """(job_id, snapshot_id, field_id, value, edit_seq): the choice of each field that held at each snapshot of its job.

    log: job_id, field_id, value, edit_seq, at; snapshots: job_id, snapshot_id, as_of (numbers of one clock). An edit holds
    from its time until the field's next edit (at one time the later edit_seq wins). Intervals and snapshots meet by job
    and bucket of `width` of the clock, an interval in every bucket that it reaches before the job's last snapshot, so that a
    job with very many edits is no single key.
    """
    nxt = F.lead("at").over(Window.partitionBy("job_id", "field_id").orderBy("at", "edit_seq"))
    held = log.withColumn("until", nxt).filter(F.col("until").isNull() | (F.col("until") > F.col("at")))
    last = snapshots.groupBy("job_id").agg(F.max("as_of").alias("last"))
    bucket = lambda c: F.floor(c / F.lit(width))
    held = held.join(last, "job_id").filter(F.col("at") <= F.col("last"))
    to = F.least(F.coalesce(F.col("until") - 1, F.col("last")), F.col("last"))
    held = held.withColumn("bucket", F.explode(F.sequence(bucket(F.col("at")), bucket(to))))
    taken = snapshots.withColumn("bucket", bucket(F.col("as_of"))).join(held.drop("last"), ["job_id", "bucket"])
    inside = (F.col("at") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until")))
    return taken.filter(inside).select("job_id", "snapshot_id", "field_id", "value", "edit_seq")


def guard_edits(edits: DataFrame, jobs: DataFrame, fields: DataFrame, accepted: DataFrame, clustered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(passed, problems).

    jobs: job_id, form_id, form_hash, analysed_hash; fields: form_id, field_id, editable and the address (RUN,
    insert_offset); accepted: job_id, field_id, value of proposals whose evidence holds. A job whose form has changed, an
    unknown or protected field, an automatic value without evidence, and two edits at one place are problems; a job with
    one passes nothing. With `clustered` all are already dealt by job_id, each form has one job, which fields name by job_id, and
    nothing is shuffled.
    """
    rows = colocated.left_join(edits, jobs, ["job_id"], clustered)
    rows = colocated.left_join(rows, fields.drop("form_id") if clustered else fields, ["job_id" if clustered else "form_id", "field_id"], clustered)
    held = accepted.select("job_id", "field_id", "value").distinct().withColumn("held", F.lit(True))
    rows = colocated.left_join(rows, held, ["job_id", "field_id", "value"], clustered)
    place = Window.partitionBy("job_id", *RUN[1:], F.coalesce("insert_offset", F.lit(-1)))
    rows = rows.withColumn("at_place", F.count("*").over(place))
    kind = (
        F.when(~F.col("form_hash").eqNullSafe(F.col("analysed_hash")), "form_changed")
        .when(F.col("editable").isNull(), "unknown_field")
        .when(~F.col("editable"), "protected_field")
        .when((F.col("origin") != "user") & ~F.coalesce("held", F.lit(False)), "no_evidence")
        .when(F.col("at_place") > 1, "overlap")
    )
    rows = rows.withColumn("type", kind)
    problems = rows.filter("type IS NOT NULL").select("job_id", "field_id", "type")
    failed = F.count("type").over(Window.partitionBy("job_id"))
    passed = rows.withColumn("failed", failed).filter("type IS NULL AND (failed = 0 OR job_id IS NULL)")
    return passed.drop("type", "at_place", "held", "failed"), problems


def apply_edits(runs: DataFrame, edits: DataFrame, clustered: bool = False) -> DataFrame:
    """runs of each job (job_id and RUN) with the edits' values: job_id, address, old_text, text.

    An edit with an insert_offset goes into the run there, several from right to left; one without replaces the run's
    text. A run without an edit stays as it is. With `clustered` both are already dealt by job_id, and nothing is shuffled.
    """
    key = ["job_id", *RUN[1:]]
    some = edits.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("insert_offset").isNotNull(), F.struct(F.col("insert_offset").alias("at"), "value"))), asc=False).alias("ins"),
        F.max(F.when(F.col("insert_offset").isNull(), F.col("value"))).alias("whole"),
    )
    put = F.aggregate("ins", F.col("text"), lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["at"]), e["value"], F.substr(acc, e["at"] + 1)))
    rows = colocated.left_join(runs.select(*key, "text"), some, key, clustered)
    text = F.coalesce(F.col("whole"), F.when(F.size("ins") > 0, put), F.col("text"))
    return rows.select(*key, F.col("text").alias("old_text"), text.alias("new_text"))


def replace_first(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """elements (form_id, seq, text) with the first one that equals an edit's old_text replaced by its value.

    Of several edits of one old_text the least value counts.
    """
    nth = F.row_number().over(Window.partitionBy("form_id", "text").orderBy("seq"))
    one = edits.groupBy("form_id", F.col("old_text").alias("text")).agg(F.min("value").alias("value"))
    rows = elements.withColumn("nth", nth).join(one, ["form_id", "text"], "left")
    return rows.select("form_id", "seq", F.when((F.col("nth") == 1) & F.col("value").isNotNull(), X.escape_value("value")).otherwise(F.col("text")).alias("text"))


def passed_jobs(rows: DataFrame, *failures: DataFrame) -> DataFrame:
    """rows of the jobs (job_id) that no table of failures names: a job with any failed check gives no output."""
    for failed in failures:
        rows = rows.join(failed.select("job_id").distinct(), "job_id", "left_anti")
    return rows


def overflow_warnings(edits: DataFrame) -> DataFrame:
    """Edits (with old_text) whose value is over 30 times as long as what it replaces."""
    old = F.length(F.coalesce("old_text", F.lit("")))
    return edits.filter((old > 0) & (F.length("value") > _LONG * old)).select("job_id", "field_id", F.length("value").alias("new_length"), old.alias("old_length"))


def fill_report(edits: DataFrame, applied: DataFrame) -> DataFrame:
    """Per job the number of applied, skipped (not selected or empty) and pending edits, and the changed fields."""
    done = applied.select("job_id", "field_id").distinct().withColumn("done", F.lit(True))
    rows = edits.join(done, ["job_id", "field_id"], "left")
    use = F.col("selected") & (F.coalesce("value", F.lit("")) != "")
    state = F.when(use & F.col("done"), "applied").when(use, "pending").otherwise("skipped")
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(f"n_{s}")
    return rows.withColumn("state", state).groupBy("job_id").agg(count("applied"), count("skipped"), count("pending"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") == "applied", F.col("field_id")))), ",").alias("changed_fields"))


def read_back(filled: DataFrame, edits: DataFrame, clustered: bool = False) -> DataFrame:
    """(job_id, field_id, value, read): each inserted value as it stands in the new run, after the shift of those before.

    With `clustered` both are already dealt by job_id, and nothing is shuffled.
    """
    key = ["job_id", *RUN[1:]]
    before = Window.partitionBy(*key).orderBy("insert_offset").rowsBetween(Window.unboundedPreceding, -1)
    rows = edits.filter("insert_offset IS NOT NULL").withColumn("shift", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)))
    rows = colocated.left_join(rows, filled.select(*key, "new_text", F.lit(True).alias("there")), key, clustered).filter("there")
    return rows.select("job_id", "field_id", "value", F.substr("new_text", (F.col("insert_offset") + F.col("shift") + 1).cast("int"), F.length("value")).alias("read"))
