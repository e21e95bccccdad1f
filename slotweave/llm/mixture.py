"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source's share of all words by weight, stopped at CAP times its size, the excess going to the
others by weight. A source's documents, in the order of a hash of their ids, form a tape that is read from
the start until the target is met, at most CAP times over; a document is taken once for every pass in which
its middle lies before the target. Curriculum: each source has a schedule of weights over PHASES equal
phases of training; its integral, scaled to the target, is the source's cumulative demand, and inverting it
at a document's place on the tape gives the training position. Documents are range-sorted by position.

A source of any size is spread over TAPES buckets by hash; only bucket sums meet, and documents are summed up
within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored, unused

CAP = 3
WEIGHTS = (1, 2, 3)
#: Schedules by phase, dealt to the sources like the weights: falling, level, rising.
SCHEDULES = ((4, 3, 2, 1), (1, 1, 1, 1), (1, 2, 3, 4))
PHASES = 4
#: Positions within a phase.
STEPS = 1_000_000
#: Buckets of a source's tape: the first hexadecimal digits of the hash.
DIGITS = 3


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with one row per source -> rank, target and the capped share's inputs.

    Sources are ranked by code point, null last; the table has one row per source, so its windows are small.
    The caps bind first where CAP * size / weight is least; after the first k such sources the rest share
    what is left, and the right k is the first at which the next cap does not bind.
    """
    deal = lambda values: F.element_at(F.array(*values), (F.pmod("rank", F.lit(len(values))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = sources.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    ranked = ranked.withColumn("weight", deal([F.lit(w).cast("long") for w in WEIGHTS])).withColumn("cap", CAP * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") * F.lit(_per(WEIGHTS)) / F.col("weight"), "rank")
    here = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    w = ranked.withColumns(
        {
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(here), F.lit(0)),
            "weights": F.sum("weight").over(onward),
            "place": F.row_number().over(by_cap),
        }
    )
    free = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights")  # the cap does not bind from here on
    w = w.withColumn("level", F.min(F.when(free, F.struct("place", "left", "weights"))).over(whole))
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weights").cast("double")
    return w.select("source", "source_size", "rank", F.when(F.col("place") >= F.col("level.place"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _per(weights: tuple[int, ...]) -> int:
    """A common multiple, so that ordering by cap / weight is exact in integers."""
    out = 1
    for w in weights:
        out *= w
    return out


def _schedule(rank: str) -> tuple[Column, Column]:
    """Cumulative schedule weights (PHASES + 1 entries) of a source and their total."""
    cumulative = []
    for s in SCHEDULES:
        run = [0]
        for w in s:
            run.append(run[-1] + w)
        cumulative.append(F.array(*[F.lit(float(x)) for x in run]))
    own = F.element_at(F.array(*cumulative), (F.pmod(rank, F.lit(len(SCHEDULES))) + 1).cast("int"))
    return own, own[PHASES]


def _position(at: Column) -> Column:
    """The training position at which a source's demand reaches a place on its tape."""
    run, total = _schedule("rank")
    used = F.least(at / F.col("target"), F.lit(1.0)) * total  # schedule weight
    phase = F.least(F.size(F.filter(run, lambda x: x <= used)) - 1, F.lit(PHASES - 1))
    inside = (used - run[phase]) / (run[phase + 1] - run[phase])
    return phase.cast("long") * STEPS + F.floor(inside * F.lit(float(STEPS)))


def _placed(docs: DataFrame, size: Column | None) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, positions): a training position for every copy that the mix takes."""
    rows = docs.select("doc_id", "source", (n_words("text") if size is None else size).alias("size"), F.xxhash64("text").alias("text_key"))
    rows = stored(rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    by = stored(rows.groupBy("source", F.substring("h", 1, DIGITS).alias("tape")).agg(F.sum("size").alias("n")), "tapes")
    source = targets(by.groupBy("source").agg(F.sum("n").alias("source_size")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("tape").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tapes = by.withColumn("before", before)  # at most 16 ** DIGITS rows a source
    tapes = stored(tapes.join(source, tapes.source.eqNullSafe(source.source)).select(tapes.source.alias("s"), "tape", "before", "source_size", "rank", "target"), "targets")

    placed = rows.withColumn("t", F.substring("h", 1, DIGITS)).join(tapes, F.col("source").eqNullSafe(F.col("s")) & (F.col("t") == F.col("tape")))
    within = Window.partitionBy("s", "tape").orderBy("h", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = [F.col("start") + k * F.col("source_size") for k in range(CAP)]
    taken = [(F.col("size") > 0) & (at + F.col("size") / F.lit(2.0) <= F.col("target")) for at in starts]
    places = [F.when(ok, _position(at)) for at, ok in zip(starts, taken, strict=True)]
    return placed.select("doc_id", "text_key", "size", "source_size", "target", F.array_compact(F.array(*places)).alias("positions"))


def mix_sources(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target (its source's), copies, taken
    (size * copies) and position, the training position of the first copy (null when not taken), range-sorted by
    position.

    size: words by default (`[^\\x20\\x09-\\x0D]+` in text, null: 0). Null is a source of its own, the last.
    Documents of size 0 are never taken; a source of size 0 has target 0. Each source's taken words differ
    from its target by at most half the size of the document at the cut. Ties on the tape are ordered by id and
    size; rows that repeat an id each take their own place. Null ids come first. An empty table gives none.
    Reruns agree: nothing depends on partitioning. Other columns are ignored.
    """
    copies = F.size("positions").cast("long")
    out = _placed(docs, size).select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), F.get("positions", F.lit(0)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The mix itself: a row of docs for every copy taken, range-sorted by training position.

    Of rows that repeat a doc_id and its text one stands for all and is taken at all their positions. Rows with a null
    doc_id are known by their text, and take their places like any other.
    """
    at, found, key, n, some_id, no_id = unused(docs.columns, "position", "positions", "text_key", "rows", "some_id", "no_id")
    known = {some_id: F.coalesce("doc_id", F.lit(0)), no_id: F.col("doc_id").isNull()}  # keys that joins find equal
    row = [some_id, no_id, key]
    some = docs.withColumns({**known, key: F.xxhash64("text")})
    taken = _placed(docs, size).withColumns(known).groupBy(some_id, no_id, F.col("text_key").alias(key)).agg(F.flatten(F.collect_list("positions")).alias(found), F.count("*").alias(n))
    taken = stored(taken.filter(F.size(found) > 0), "taken")
    twice = small(taken.filter(F.col(n) > 1).select(*row), "taken-twice")
    some = some.join(twice, row, "left_anti").unionByName(some.join(twice, row, "left_semi").dropDuplicates(row))
    copies = some.join(taken, row).withColumn(at, F.explode(found))
    return copies.orderBy(at, "doc_id").select(*docs.columns)
