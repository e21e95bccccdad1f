"""The given tables as sources, forms, jobs, cells, proposals and edits.

Irregular cases (a missing line, a conflicting line, a forged quote, a blank cell) are dealt by key.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.schemas import struct

#: (form, field, label, unit, editable): what the forms ask of an order's document.
FORM_FIELDS = [
    ("f0", "f0-1", "Customer", None, True),
    ("f0", "f0-2", "Status", None, True),
    ("f0", "f0-3", "금액", "천원", True),
    ("f0", "f0-4", "Date", None, True),
    ("f1", "f1-1", "customer", None, True),
    ("f1", "f1-2", "Total", None, True),
    ("f1", "f1-3", "Clerk", None, True),
    ("f1", "f1-4", "", None, True),
    ("f2", "f2-1", "STATUS", None, True),
    ("f2", "f2-2", "금액", None, True),
    ("f2", "f2-3", "Priority", None, False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def form_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORM_FIELDS, "form_id string, field_id string, label string, unit string, editable boolean")


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, text): a Markdown document per order, its line items as a pipe table."""
    orders, customer, items = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    number = lambda c: F.col(c).cast("bigint").cast("string")
    row = F.concat(F.lit("| "), number("l_linenumber"), F.lit(" | p\\|"), number("l_partkey"), F.lit(" | "), number("l_quantity"), F.lit(" |"))
    grid = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(grid, orders.o_orderkey == grid.l_orderkey, "left")
    key = F.col("o_orderkey")
    cents = F.col("o_totalprice").cast("bigint").cast("string")
    lines = F.array(
        F.concat(F.lit("# Order "), key.cast("string")),
        F.concat(F.lit("Customer: "), F.coalesce("c_name", F.lit("?")), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(", Status: "), F.col("o_orderstatus"))), F.lit("; Total: "), cents),
        F.concat(F.lit("금액: "), cents, F.lit("천원")),
        F.concat(F.lit("Date "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(key % 7 == 0, F.lit("status: X")).otherwise(F.lit("")),
        F.lit("## Lines"),
        F.lit("| Line | Part | Qty |"),
        F.lit("|---|:--|--:|"),
        F.coalesce("rows", F.lit("")),
        F.concat(F.lit("Priority: "), F.col("o_orderpriority")),
    )
    return rows.select(F.concat(F.lit("o-"), key.cast("string")).alias("doc_id"), F.lit("md").alias("kind"), F.array_join(lines, "\n").alias("text"), key.alias("order_key"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, form_id, doc_id): a fill job per order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("j-"), key.cast("string")).alias("job_id"), F.concat(F.lit("f"), (key % 3).cast("string")).alias("form_id"), F.concat(F.lit("o-"), key.cast("string")).alias("doc_id"))


def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each job; the forms' field list is small by construction."""
    return jobs(spark, sf_dir).join(F.broadcast(form_fields(spark)), "form_id")


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native cell grid per order: a header row, a row of labels beside cells, a row per line item, a total row.

    form_id is the order; cells are blank where l_partkey is even or the price is asked for. Only lines are shuffled, and the cells
    of a form lie together, hashed by form_id.
    """
    item = F.struct(F.col("l_linenumber").cast("int").alias("r"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    form = F.concat(F.lit("g-"), F.col("l_orderkey").cast("string")).alias("form_id")
    forms = table(spark, sf_dir, "lineitem").groupBy(form).agg(F.collect_list(item).alias("items"), F.max(F.col("l_linenumber").cast("int")).alias("n"))  # an order's lines
    cell = lambda row, col, text, span=1: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(span).alias("col_span"), text.alias("text"))
    blank = lambda i: F.when(i["p"] % 2 == 0, F.lit("")).otherwise(i["q"].cast("bigint").cast("string"))
    line = lambda i: F.array(
        cell(i["r"] + 1, 0, F.concat(F.lit("item "), i["r"].cast("string"))),
        cell(i["r"] + 1, 1, blank(i)),
        cell(i["r"] + 1, 2, F.when(i["p"] % 3 == 0, F.lit("천원")).otherwise(F.lit(""))),
        cell(i["r"] + 1, 3, i["p"].cast("string")),
    )
    frame = F.array(
        cell(F.lit(0), 0, F.lit("품명")), cell(F.lit(0), 1, F.lit("2023 수입")), cell(F.lit(0), 2, F.lit("금액 (단위: 천원)")), cell(F.lit(0), 3, F.lit("2024 지출")),
        cell(F.lit(1), 0, F.lit("성명")), cell(F.lit(1), 1, F.lit(""), 2), cell(F.lit(1), 3, F.lit("※ 필수")),
        cell(F.col("n") + 2, 0, F.lit("합계")), cell(F.col("n") + 2, 1, F.lit("")), cell(F.col("n") + 2, 2, F.lit("원")), cell(F.col("n") + 2, 3, F.lit("")),
        cell(F.col("n") + 3, 0, F.lit("품명")), cell(F.col("n") + 3, 1, F.lit("전화 : ")), cell(F.col("n") + 3, 2, F.lit("")), cell(F.col("n") + 3, 3, F.lit("")),
    )
    # The lines are exploded first and their cells after that, so that no cell is made inside a lambda.
    none = F.struct(F.lit(None).cast("int").alias("r"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast(forms.schema["items"].dataType.elementType["q"].dataType).alias("q"))
    each = forms.select("form_id", "n", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("frame"), none.alias("i"))), F.transform("items", lambda i: F.struct(F.lit(False).alias("frame"), i.alias("i"))))).alias("e"))
    rows = each.select("form_id", F.lit("s0").alias("section"), F.lit(0).alias("table_idx"), F.inline(F.when(F.col("e.frame"), frame).otherwise(line(F.col("e.i")))))
    return rows.withColumns({"row_span": F.lit(1), "has_nested": F.lit(False), "has_controls": F.lit(False)})


def grid_runs(cells: DataFrame) -> DataFrame:
    """One paragraph with one run per cell."""
    return cells.select("form_id", "section", "table_idx", "row", "col", F.lit(0).alias("para"), F.lit(0).alias("run"), "text")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], struct(ddl))


def zipped_forms(spark: SparkSession) -> DataFrame:
    """(form_id, payload): the forms of FORM_FIELDS as packages, each a table of labels beside empty cells."""
    from slotweave.sources.packages import MANIFEST, MIMETYPE, OWN_NAMESPACE

    out = []
    for form in sorted({f for f, *_ in FORM_FIELDS}):
        pairs = [("항목", "내용"), *((label, "") for f, _, label, *_ in FORM_FIELDS if f == form)]
        cell = '<tc><cellAddr rowAddr="{i}" colAddr="{j}"/><subList><p><run><t>{t}</t></run></p></subList></tc>'
        rows = "".join("<tr>" + "".join(cell.format(i=i, j=j, t=escape(t)) for j, t in enumerate(pair)) + "</tr>" for i, pair in enumerate(pairs))
        parts = [
            ("mimetype", MIMETYPE),
            ("Contents/section0.xml", f'<sec xmlns="{OWN_NAMESPACE}2011/section"><p><run><tbl>{rows}</tbl></run></p></sec>'.encode()),
            (MANIFEST, b'<package><manifest><item id="a" href="Contents/section0.xml"/></manifest><spine><itemref idref="a"/></spine></package>'),
        ]
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for path, content in parts:
                z.writestr(zipfile.ZipInfo(path), content)
        out.append((form, data.getvalue()))
    return spark.createDataFrame(out, "form_id string, payload binary")


def zipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form_id, payload): a zipped form per document, its lines as a table in the first of two sections.

    The spine names the sections against the order of their names; some forms have a fault, a table inside a cell or a
    foreign element, dealt by key. Characters that XML has no place for are written as U+FFFD.
    """
    from slotweave.sources.packages import MANIFEST, MIMETYPE, OWN_NAMESPACE

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                row = '<tr><tc><cellAddr rowAddr="{i}" colAddr="0"/><subList><p><run><t>line {i}</t></run></p></subList></tc><tc><cellAddr rowAddr="{i}" colAddr="1"/><cellSpan colSpan="2" rowSpan="1"/><subList><p><run><t>{t}</t></run></p></subList></tc></tr>'
                rows = "".join(row.format(i=i, t=escape(line)) for i, line in enumerate(text.split("\n")))
                if k % 9 == 8:
                    inner = "<p><run><tbl><tr><tc><subList><p><run><t>inner</t></run></p></subList></tc></tr></tbl></run></p>"
                    rows = rows.replace("</subList>", f"{inner}</subList>", 1)
                foreign = '<x:p xmlns:x="urn:other"/>' if k % 9 == 8 else ""
                items = "".join(f'<item id="{i}" href="{h}"/>' for i, h in (("a", "Contents/section1.xml"), ("b", "Contents/section0.xml"), ("h", "Contents/header.xml")))
                parts = [
                    ("mimetype", b"text/plain" if k % 9 == 3 else MIMETYPE),
                    ("../x" if k % 9 == 4 else "Preview/PrvText.txt", text.encode()),
                    ("Contents/section0.xml", b"<sec><p/></sec>" if k % 9 != 7 else b"<!DOCTYPE x><sec/>"),
                    ("Contents/section1.xml", f'<sec xmlns="{OWN_NAMESPACE}2011/section"><p><run><t>doc {k}</t></run></p><p><run><tbl>{rows}</tbl></run></p>{foreign}</sec>'.encode()),
                    ("Contents/header.xml", b"<head/>"),
                    ("Contents/other.hpf" if k % 9 == 5 else MANIFEST, f'<package><manifest>{items}</manifest><spine><itemref idref="h"/><itemref idref="a"/><itemref idref="b"/>{"<itemref idref=%s/>" % chr(34).join(["", "zz", ""]) if k % 9 == 6 else ""}</spine></package>'.encode()),
                ]
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for path, content in parts:
                        z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
                out.append((f"d-{k}", data.getvalue()))
            yield pd.DataFrame(out, columns=["form_id", "payload"])

    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b-\x1f]", "\ufffd")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.mapInPandas(build, "form_id string, payload binary")


def zipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form_id, payload): an order's document as a package of two sections with a table each.

    Cells carry no address: the first table has a cell over two columns and one over all its rows, so that places follow
    from spans. Captions and section marks stand as paragraphs before the tables; some documents lack the second caption.
    """
    from slotweave.sources.packages import MANIFEST, MIMETYPE, OWN_NAMESPACE

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = lambda text, rows=1, cols=1: f'<tc><subList><p><run><t>{escape(str(text))}</t></run></p></subList><cellSpan rowSpan="{rows}" colSpan="{cols}"/></tc>'
        line = lambda *cells: f"<tr>{''.join(cells)}</tr>"
        para = lambda text: f"<p><run><t>{escape(text)}</t></run></p>"
        section = lambda *parts: f'<sec xmlns="{OWN_NAMESPACE}2011/section">{"".join(parts)}</sec>'.encode()
        items = "".join(f'<item id="{i}" href="Contents/section{i}.xml"/>' for i in (0, 1))
        manifest = f'<package><manifest>{items}</manifest><spine><itemref idref="0"/><itemref idref="1"/></spine></package>'.encode()
        for pdf in batches:
            out = []
            for key, clerk, cents, numbers, parts, supps in pdf.itertuples(index=False):
                lines = [line(*([cell("2024", len(numbers))] if i == 0 else []), cell(f"line {n}"), cell(p), cell(s)) for i, (n, p, s) in enumerate(zip(numbers, parts, supps, strict=True))]
                first = f"<p><run><tbl>{line(cell('구분'), cell('품명'), cell('금액', 1, 2))}{''.join(lines)}</tbl></run></p>"
                second = f"<p><run><tbl>{line(cell('이름'), cell('금액'))}{line(cell(clerk), cell(cents))}</tbl></run></p>"
                sections = [section(para(f"문서 {key}"), para("구역: 앞"), para("표: 예산"), para(""), first), section(para("구역: 뒤"), *([] if key % 8 == 0 else [para(" 표:지출 ")]), second)]
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for path, content in (("mimetype", MIMETYPE), ("Contents/section0.xml", sections[0]), ("Contents/section1.xml", sections[1]), (MANIFEST, manifest)):
                        z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
                out.append((f"o-{key}", data.getvalue()))
            yield pd.DataFrame(out, columns=["form_id", "payload"])

    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    items = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p", "s"))).alias("x"))  # an order's lines
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    numbers = [F.col(f"x.{c}").cast("array<long>").alias(c) for c in ("l_linenumber", "p", "s")]
    rows = orders.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("bigint").cast("string").alias("cents"), *numbers)
    return rows.mapInPandas(build, "form_id string, payload binary")


def styled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form_id, payload): a document as a package whose header defines styles, and whose lines refer to them.

    The ids of a style differ from form to form; some forms have no caption style, some refer to an id that isn't defined,
    and every form has a table whose cells are set as captions.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                names = ["바탕글", "개요 1", *(["캡션"] if k % 4 else [])]
                styles = "".join(f'<style id="{k % 3 + i}" name="{name}" paraPrIDRef="{10 + i + k % 2}" charPrIDRef="{20 + i}"/>' for i, name in enumerate(names))
                header = f"<head><charProperties><charPr id=\"20\"/></charProperties><styles>{styles}</styles></head>"
                used = lambda i: 1 if i % 5 == 0 else 2 if i % 5 == 4 and k % 4 else 0  # noqa: B023, E731
                para = lambda i, style: f'<p styleIDRef="{style}" paraPrIDRef="{10 + i}" charPrIDRef="0"><run charPrIDRef="{20 + i}"><t>x</t></run></p>'
                lines = "".join(para(used(i), 99 if k % 7 == 6 and i == 0 else k % 3 + used(i)) for i, _ in enumerate(text.split("\n")))
                table = f"<p><run><tbl><tr>{'<tc><subList>' + para(2, k % 3 + 2) + '</subList></tc>'}</tr></tbl></run></p>" * 9
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(zipfile.ZipInfo("Contents/header.xml"), header)
                    z.writestr(zipfile.ZipInfo("Contents/section0.xml"), f"<sec>{lines}{table}</sec>")
                out.append((f"d-{k}", data.getvalue()))
            yield pd.DataFrame(out, columns=["form_id", "payload"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(build, "form_id string, payload binary")
