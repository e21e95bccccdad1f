"""Zipped forms: entries, guards, section order, and sections as cell, run and element rows.

The two helpers that read zips and XML work on bytes in memory, batch by batch; guards and order are joins and windows.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.schemas import ENTRIES

MAX_ENTRIES, MAX_BYTES = 5_000, 50_000_000
MIMETYPE = b"application/hwp+zip"
MANIFEST = "Contents/content.hpf"


def unzip(payload: bytes) -> Iterator[tuple]:
    """(pos, path, method, size, crc_ok, encrypted, sha256, content, error) of each entry; stops at the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(payload))
    except (zipfile.BadZipFile, ValueError) as e:
        yield (0, "", 0, 0, False, False, None, None, f"BAD_ZIP: {e}"[:80])
        return
    total = 0
    for pos, info in enumerate(archive.infolist()):
        if pos >= MAX_ENTRIES:
            yield (pos, info.filename, info.compress_type, info.file_size, False, False, None, None, "TOO_MANY_ENTRIES")
            return
        locked = bool(info.flag_bits & 1)
        content, ok = None, False
        total += info.file_size
        if not locked and total <= MAX_BYTES and info.compress_type in (0, 8):
            try:
                content = archive.read(info)
                ok = zlib.crc32(content) == info.CRC
            except (zipfile.BadZipFile, zlib.error, EOFError):
                content = None
        yield (pos, info.filename, info.compress_type, info.file_size, ok, locked, hashlib.sha256(content).hexdigest() if content is not None else None, content, None)
        if total > MAX_BYTES:
            return


def in_batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `limit` bytes, whatever they come from: many small forms share a batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a plain DDL string."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def entries_of(packages: DataFrame) -> DataFrame:
    """Entry rows of packages (form_id, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["form_id", "pos", "path", "method", "size", "crc_ok", "encrypted", "sha256", "content", "error"]

        def rows() -> Iterator[dict]:
            for batch in batches:
                for form, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from (dict(zip(names, (form, *entry), strict=True)) for entry in unzip(payload.as_py() or b""))

        yield from in_batches(rows(), arrow_schema(ENTRIES))

    return packages.select("form_id", "payload").mapInArrow(run, ENTRIES)


def read_packages(spark: SparkSession, glob: str) -> DataFrame:
    """Entry rows of the zipped forms under a path; the file's path is the form's id."""
    files = spark.read.format("binaryFile").load(glob)
    return entries_of(files.select(F.col("path").alias("form_id"), F.col("content").alias("payload")))


def check_packages(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok entries, problems (form_id, path, code)): forms that fail a guard leave with all their entries.

    Only the entries' columns besides content are shuffled, once, by form; entries are read again for the result, so they
    should be a stored table.
    """
    first = (F.col("pos") == 0) & ~((F.col("path") == "mimetype") & (F.col("method") == 0) & (F.col("content") == F.lit(MIMETYPE)))
    rows = entries.withColumn("_first", first).drop("content")
    form, so_far = Window.partitionBy("form_id"), Window.partitionBy("form_id").orderBy("pos")
    rows = rows.withColumns({"_sum": F.sum("size").over(so_far), "_has": F.max(F.col("path") == MANIFEST).over(form)})
    rows = rows.withColumn("_copies", F.count("*").over(Window.partitionBy("form_id", "path")))
    code = (
        F.when(F.col("error").isNotNull(), F.substring_index("error", ":", 1))
        .when(F.col("_copies") > 1, "DUPLICATE_PATH")
        .when(F.col("path").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|\x00"), "UNSAFE_PATH")
        .when(F.col("encrypted"), "ENCRYPTED")
        .when(~F.col("method").isin(0, 8), "BAD_METHOD")
        .when(F.col("_sum") > MAX_BYTES, "TOO_LARGE")
        .when(~F.col("crc_ok"), "BAD_CRC")
        .when(F.col("_first"), "BAD_MIMETYPE")
    )
    rows = rows.withColumn("code", code).withColumn("_bad", F.max(F.col("code").isNotNull()).over(form))
    absent = ~F.col("_bad") & ~F.col("_has")  # said of forms without another problem
    rows = rows.withColumns({"path": F.when(absent, MANIFEST).otherwise(F.col("path")), "code": F.when(absent, "MISSING_PART").otherwise(F.col("code"))})
    problems = rows.filter("code IS NOT NULL").select("form_id", "path", "code").distinct()
    return entries.join(problems.select("form_id").distinct(), "form_id", "left_anti"), problems


def manifest_rows(entries: DataFrame) -> DataFrame:
    """(form_id, kind (item or ref), ord, item_id, path) of each form's manifest entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for form, content in zip(pdf["form_id"], pdf["content"], strict=True):
                try:
                    root = ET.fromstring(bytes(content))
                except ET.ParseError:
                    continue
                local = [(e.tag.rsplit("}", 1)[-1], e) for e in root.iter()]
                rows += [(form, "item", -1, e.get("id"), e.get("href")) for t, e in local if t == "item"]
                rows += [(form, "ref", i, e.get("idref"), None) for i, e in enumerate(e for t, e in local if t == "itemref")]
            yield pd.DataFrame(rows, columns=["form_id", "kind", "ord", "item_id", "path"])

    return entries.filter(F.col("path") == MANIFEST).select("form_id", "content").mapInPandas(run, "form_id string, kind string, ord int, item_id string, path string")


def manifests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest (form_id, item_id, path), spine (form_id, ord, item_id)) of manifest_rows."""
    return rows.filter("kind = 'item'").select("form_id", "item_id", "path"), rows.filter("kind = 'ref'").select("form_id", "ord", "item_id")


def resolve_spine(manifest: DataFrame, spine: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections (form_id, ord, path, content), problems (form_id, item_id, code)) in the order of the spine, not of names.

    A reference without an item or file, or a second one to the same item, is a problem; other parts are passed over.
    """
    nth = F.row_number().over(Window.partitionBy("form_id", "item_id").orderBy("ord"))
    rows = spine.withColumn("nth", nth).join(manifest, ["form_id", "item_id"], "left").join(entries.select("form_id", "path", "content"), ["form_id", "path"], "left")
    code = F.when(F.col("path").isNull(), "BROKEN_REF").when(F.col("content").isNull(), "MISSING_PART").when(F.col("nth") > 1, "DUPLICATE_REF")
    rows = rows.withColumn("code", code)
    sections = rows.filter(F.col("code").isNull() & F.col("path").rlike(r"(^|/)section\d+\.xml$"))
    return sections.select("form_id", "ord", "path", "content"), rows.filter("code IS NOT NULL").select("form_id", "item_id", "code")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


#: Namespaces of the format itself begin so (fixed value).
OWN_NAMESPACE = "http://www.hancom.co.kr/hwpml/"
_BOX = ["table_idx", "row", "col", "row_span", "col_span"]


class TableState:
    """Where the cells of a table stand: as addressed, else in the first free column, spans from above counted."""

    def __init__(self) -> None:
        self.number, self.at, self._column, self._taken = 0, -1, 0, {}

    def row(self) -> TableState:
        self.at += 1
        self._column = 0
        self._taken = {c: end for c, end in self._taken.items() if end > self.at}
        return self

    def place(self, address: tuple[int, str | None] | None, spans: tuple[int, int]) -> tuple[int, int, int]:
        """(table, row, column) of the next cell with the given address, if any, and (rows, columns) that it spans."""
        row, column = address or (self.at, None)
        if column is None:
            while self._column in self._taken:
                self._column += 1
            column = self._column
        column = int(column)
        for c in range(column, column + max(spans[1], 1)):
            self._taken[c] = max(self._taken.get(c, 0), row + max(spans[0], 1))
        self._column = column + max(spans[1], 1)
        return self.number, row, column


class Tables:
    """Tables of a section, numbered in the order in which they begin."""

    def __init__(self) -> None:
        self._count = itertools.count()

    def table(self) -> TableState:
        state = TableState()
        state.number = next(self._count)
        return state


def section_rows(content: bytes) -> Iterator[dict]:
    """Rows of a section in document order, by kind.

    table: a table (numbered over the section, inner ones too) with the cell that it lies in, if any, as row, col and
    para (its parent's number); cell: with its own runs' text, what inner tables hold left out; run: of a cell; para: a
    paragraph's own text with the address of the nearest cell, if any (place orders tables and paragraphs); element: each namespace and local name once.
    """
    root = ET.fromstring(content)
    kids = lambda node, name: [c for c in node if _local(c.tag) == name]
    tables, paras, places = Tables(), itertools.count(), itertools.count()
    said = lambda run: "".join("".join(t.itertext()) for t in kids(run, "t"))

    def table(node: ET.Element, cell: dict) -> Iterator[dict]:
        state = tables.table()
        t = state.number
        yield {"kind": "table", "table_idx": t, "row": cell.get("row"), "col": cell.get("col"), "para": cell.get("table_idx"), "place": next(places)}
        for tr in kids(node, "tr"):
            state.row()
            for tc in kids(tr, "tc"):
                addr, span = (kids(tc, "cellAddr") or [None])[0], (kids(tc, "cellSpan") or [None])[0]
                spans = (int(span.get("rowSpan", 1)), int(span.get("colSpan", 1))) if span is not None else (1, 1)
                at = state.place((int(addr.get("rowAddr", state.at)), addr.get("colAddr")) if addr is not None else None, spans)
                box = dict(zip(_BOX, (*at, *spans), strict=True))
                runs = [(p, q, said(run)) for sub in kids(tc, "subList") for p, para in enumerate(kids(sub, "p")) for q, run in enumerate(kids(para, "run"))]
                names = {_local(e.tag) for e in tc.iter()}
                yield {"kind": "cell", **box, "text": "".join(x for _, _, x in runs), "has_nested": "tbl" in names, "has_controls": bool(names & {"ctrl", "pic", "equation", "ole"})}
                yield from ({"kind": "run", **box, "para": p, "run": q, "text": x} for p, q, x in runs)
                yield from walk(tc, box)

    def walk(node: ET.Element, cell: dict) -> Iterator[dict]:
        for child in node:
            name = _local(child.tag)
            if name == "tbl":
                yield from table(child, cell)
                continue
            if name == "p":
                yield {"kind": "para", **cell, "para": next(paras), "place": next(places), "text": "".join(said(run) for run in kids(child, "run"))}
            yield from walk(child, cell)

    yield from walk(root, {})
    for tag in sorted({e.tag for e in root.iter() if isinstance(e.tag, str)}):
        yield {"kind": "element", "namespace": tag[1:].split("}")[0] if tag[0] == "{" else "", "name": _local(tag)}


def section_parts(sections: DataFrame) -> DataFrame:
    """All rows of sections (form_id, path, content and perhaps ord), see section_rows, with the section's path and ord; a
    section that can't be read gives one row of kind `problem` whose name is the code. DOCTYPE and ENTITY are unsafe.

    A section is parsed here once; what follows reads these rows, so they should be stored where several need them."""

    kinds = {"form_id": "string", "section": "string", "ord": "int", "kind": "string", **dict.fromkeys(_BOX, "int"), "text": "string", "has_nested": "boolean", "has_controls": "boolean", "para": "int", "run": "int", "place": "int", "namespace": "string", "name": "string"}
    ddl = ", ".join(f"{name} {kind}" for name, kind in kinds.items())

    def parsed(section: dict) -> list[dict]:
        data = section["content"]
        own = {"form_id": section["form_id"], "section": section["path"], "ord": section["ord"]}
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            return [{**own, "kind": "problem", "name": "UNSAFE_XML"}]
        try:
            return [{**own, **row} for row in section_rows(data)]
        except (ET.ParseError, ValueError):
            return [{**own, "kind": "problem", "name": "BAD_XML"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((row for batch in batches for section in batch.to_pylist() for row in parsed(section)), arrow_schema(ddl))

    order = F.col("ord").cast("int") if "ord" in sections.columns else F.lit(None).cast("int")
    return sections.select("form_id", "path", "content", order.alias("ord")).mapInArrow(run, ddl)


def cells_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'cell'").select("form_id", "section", *_BOX, "text", "has_nested", "has_controls")


def runs_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'run'").select("form_id", "section", "table_idx", "row", "col", "para", "run", "text")


def problems_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'problem'").select("form_id", F.col("section").alias("path"), F.col("name").alias("code"))


def parse_sections(sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, runs, problems (form_id, path, code)) of sections (form_id, path, content)."""
    parts = section_parts(sections)
    return cells_of(parts), runs_of(parts), problems_of(parts)


def section_paragraphs(parts: DataFrame) -> DataFrame:
    """(form_id, ord, section, seq, table address, text): paragraphs of section_parts in the order of the form; seq rises over
    all its sections."""
    rows = parts.filter("kind = 'para'").select("form_id", "section", *_BOX, "para", "text", "ord")
    return rows.withColumn("seq", F.shiftleft(F.col("ord").cast("long"), 32) + F.col("para")).drop("para")


def table_scopes(parts: DataFrame, marks: dict[str, str]) -> DataFrame:
    """(form_id, part, table_idx, a column for each mark): what the last paragraph before a table says behind each mark
    and a colon, all sections of the form in order; null where none stands before it.

    An as-of join of marked paragraphs outside of tables to tables, as one window over both.
    """
    rows = parts.filter("kind = 'table' OR kind = 'para' AND table_idx IS NULL").select("form_id", F.col("section").alias("part"), "table_idx", "ord", "place", "kind", "text")
    before = Window.partitionBy("form_id").orderBy("ord", "place").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda mark: F.when((F.col("kind") == "para") & X.strip("text").startswith(f"{mark}:"), X.strip(F.substr(X.strip("text"), F.lit(len(mark) + 2))))
    rows = rows.withColumns({name: F.last(said(mark), ignorenulls=True).over(before) for name, mark in marks.items()})
    return rows.filter("kind = 'table'").select("form_id", "part", "table_idx", *marks)


def nested_tables(parts: DataFrame) -> DataFrame:
    """(form_id, section, table_idx, parent_table, parent_row, parent_col) of the tables that lie in a cell."""
    rows = parts.filter("kind = 'table' AND para IS NOT NULL")
    return rows.select("form_id", "section", "table_idx", F.col("para").alias("parent_table"), F.col("row").alias("parent_row"), F.col("col").alias("parent_col"))


def section_elements(parts: DataFrame) -> DataFrame:
    """(form_id, section, namespace, local_name, foreign): the names that a section uses."""
    rows = parts.filter("kind = 'element'")
    return rows.select("form_id", "section", "namespace", F.col("name").alias("local_name"), (~F.col("namespace").startswith(OWN_NAMESPACE)).alias("foreign"))


def ns_clashes(elements: DataFrame) -> DataFrame:
    """(form_id, section, local_name): names used in an own and in a foreign namespace of one section.

    elements: form_id, section, namespace, local_name, foreign.
    """
    rows = elements.groupBy("form_id", "section", "local_name").agg(F.bool_or("foreign").alias("f"), F.bool_or(~F.col("foreign")).alias("o"))
    return rows.filter("f AND o").select("form_id", "section", "local_name")

