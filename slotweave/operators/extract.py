"""Source extraction: documents to ordered, offset blocks with headings, table positions and facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slotweave.functions import textfn as X

MAX_BYTES = 6000


def in_doc() -> WindowSpec:
    """One specification for all windows of a document, so they share one shuffle and one sort."""
    return Window.partitionBy("doc_id").orderBy("seq")


def before() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, 0)


def with_doc_hash(docs: DataFrame) -> DataFrame:
    """doc_hash: SHA-256 of the text's bytes."""
    return docs.withColumn("doc_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, seq, text): the lines of every document in order, empty ones too; none for an empty text."""
    rows = with_doc_hash(docs.filter(F.col("text") != ""))
    return rows.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """start and end: character offsets in the document, a newline counting one."""
    start = F.coalesce(F.sum(F.length("text") + 1).over(before()), F.lit(0)).cast("long")
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def with_block_id(blocks: DataFrame) -> DataFrame:
    """block_id: the same for the same document content and place."""
    key = F.concat_ws(":", "doc_hash", F.col("seq").cast("string"))
    return blocks.withColumn("block_id", F.concat(F.lit("b-"), F.substring(F.sha2(key, 256), 1, 24)))


def with_heading_context(blocks: DataFrame) -> DataFrame:
    """level: the line's own heading level; heading: the level in force, 0 before the first heading."""
    blocks = blocks.withColumn("level", X.md_level("text"))
    return blocks.withColumn("heading", F.coalesce(F.last("level", ignorenulls=True).over(so_far()), F.lit(0)))


def with_table_position(blocks: DataFrame) -> DataFrame:
    """t_row, t_col, header (joined by |) and is_header: the state a table line finds, null for a table's first line.

    Lines of a table follow one another. A line that is not a separator, nor follows one, adds a row; the column is
    that of the last cell of the line before. The header is the line above the separator.
    """
    rows = blocks.withColumns({"is_row": X.is_md_table_row("text"), "is_sep": X.is_md_table_row("text") & X.is_md_separator("text"), "cells": X.md_cells("text")})
    rows = rows.withColumn("island", F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(so_far()))
    in_table = Window.partitionBy("doc_id", "island").orderBy("seq")
    rows = rows.withColumn("first", F.col("is_row") & ~F.coalesce(F.lag("is_row").over(in_doc()), F.lit(False)))
    adds = F.col("is_row") & ~F.col("is_sep") & ~F.coalesce(F.lag("is_sep").over(in_table), F.lit(False))
    title = F.when(F.col("is_sep"), F.concat_ws("|", F.lag("cells").over(in_table)))
    rows = rows.withColumns({"adds": adds.cast("int"), "title": title})
    earlier = in_table.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("is_row") & ~F.col("first")
    last_col = F.when(F.lag("is_sep").over(in_table), 0).otherwise(F.size(F.lag("cells").over(in_table)) - 1)
    rows = rows.withColumns(
        {
            "t_row": F.when(inside, F.sum("adds").over(earlier)).cast("int"),
            "t_col": F.when(inside, last_col),
            "header": F.when(inside, F.coalesce(F.last("title", ignorenulls=True).over(earlier), F.lit(""))),
            "is_header": F.when(inside, F.lag("is_sep").over(in_table)),
        }
    )
    return rows.drop("is_row", "is_sep", "cells", "island", "first", "adds", "title")


def block_context(blocks: DataFrame) -> DataFrame:
    """context: what is known of a block's place, as strings, for blocks with heading, t_row, t_col and header."""
    at = F.array_compact(
        F.array(
            F.concat(F.lit("h"), F.col("heading").cast("string")),
            F.concat(F.lit("row="), F.col("t_row").cast("string")),
            F.concat(F.lit("col="), F.col("t_col").cast("string")),
            F.when(F.col("header") != "", F.concat(F.lit("header="), F.col("header"))),
        )
    )
    return blocks.withColumn("context", at)


def explode_facts(blocks: DataFrame, *keep: str) -> DataFrame:
    """A row per fact of each block's text: keep, fact_pos, fact, label, norm, value."""
    rows = blocks.select(*keep, F.posexplode(X.facts("text")).alias("fact_pos", "fact"))
    return rows.withColumns({"label": X.label_of("fact"), "value": X.value_of("fact")}).withColumn("norm", X.norm_label("label"))


def paragraph_blocks(paragraphs: DataFrame) -> DataFrame:
    """Non-empty paragraphs (doc_id, seq, text, table address) as blocks with offsets; their own text only."""
    return with_offsets(paragraphs.filter(~X.is_blank("text")))


def own_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, cell_id, text): text nodes (doc_id, cell_id, seq, text) joined in the cell nearest to them.

    A nested table's text belongs to its own cells, so it is counted once.
    """
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))  # one cell's nodes
    return nodes.groupBy("doc_id", "cell_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def _cut(text: str, limit: int) -> list[str]:
    data, out, at = text.encode(), [], 0
    while len(data) - at > limit:
        end = at + limit
        while end > at and (data[end] & 0xC0) == 0x80:
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return [*out, data[at:].decode()]


def split_long_blocks(blocks: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """blocks with parent_id, part_index and part_count; texts of over `limit` UTF-8 bytes become several rows.

    Cuts fall between characters. Only long blocks pass through Python.
    """

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cut(t, limit))

    long = F.coalesce(F.octet_length("text") > limit, F.lit(False))
    rows = blocks.filter(~long).withColumn("parts", F.array("text")).unionByName(blocks.filter(long).withColumn("parts", F.pandas_udf(cut, "array<string>")("text")))
    rows = rows.withColumn("part_count", F.size("parts")).withColumnRenamed("block_id", "parent_id")
    rows = rows.drop("text").select("*", F.posexplode("parts").alias("part_index", "text")).drop("parts")
    name = F.when(F.col("part_count") > 1, F.concat_ws(".", "parent_id", F.col("part_index").cast("string"))).otherwise(F.col("parent_id"))
    return rows.withColumn("block_id", name)


def rejoin(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): blocks (seq, part_index) joined again; equal to the document."""
    lines = blocks.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_list(F.struct("part_index", "text"))).alias("p"))
    lines = lines.select("doc_id", "seq", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("line"))
    whole = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))  # one document
    return whole.select("doc_id", F.array_join(F.transform("l", lambda p: p["line"]), "\n").alias("text"))


def extract_status(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, status, n_blocks, warning): unsupported kind, failed (no text), empty, partial (a long block) or extracted."""
    n = blocks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("longest"))
    rows = docs.select("doc_id", "kind", "text").join(n, "doc_id", "left")
    known = F.col("kind").isin("txt", "md", "hwpx")
    status = (
        F.when(~F.coalesce(known, F.lit(False)), "unsupported")
        .when(F.col("text").isNull(), "failed")
        .when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("longest") > MAX_BYTES, "partial")
        .otherwise("extracted")
    )
    warning = F.when(status == "unsupported", "unknown kind").when(status == "partial", "a block is over the size limit").otherwise("")
    return rows.select("doc_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_blocks"), warning.alias("warning"))


def with_norm_text(blocks: DataFrame, norms: DataFrame) -> DataFrame:
    """search_text: the normalised text of norms (doc_id, block_id, norm_text) where there is one; text stays."""
    return blocks.join(norms, ["doc_id", "block_id"], "left").withColumn("search_text", F.coalesce("norm_text", "text")).drop("norm_text")


def resolve_kind(kind: Column | str, path: Column | str) -> Column:
    """txt, md or hwpx as told, else by the file's ending; null if neither says."""
    told = F.lower(F.coalesce(X._c(kind), F.lit("")))
    end = F.lower(F.regexp_extract(X._c(path), r"\.([^./]+)$", 1))
    short = lambda c: F.when(c.isin("md", "markdown"), "md").when(c.isin("txt", "text", "paste"), "txt").when(c == "hwpx", "hwpx")
    return F.coalesce(short(told), F.when(told == "", short(end)))


def blocks_of(docs: DataFrame) -> DataFrame:
    """The whole extraction of text documents: one shuffle by document."""
    rows = with_heading_context(with_offsets(with_block_id(line_blocks(docs))))
    return block_context(with_table_position(rows))

