import io
import zipfile

from slotweave.sources import packages


def pack(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path, content, method in parts:
            z.writestr(zipfile.ZipInfo(path), content, method)
    return data.getvalue()


GOOD = [("mimetype", packages.MIMETYPE, 0), (packages.MANIFEST, b"<p/>", 8)]


def test_guards(spark):
    forms = {
        "good": pack(GOOD),
        "late": pack(GOOD[::-1]),
        "path": pack([*GOOD, ("a/../../b", b"", 8)]),
        "none": pack(GOOD[:1]),
        "junk": b"not a zip",
        "crc": pack(GOOD).replace(b"<p/>", b"<q/>") if b"<p/>" in pack([(p, c, 0) for p, c, _ in GOOD]) else b"",
        "empty": b"",
    }
    entries = packages.entries_of(spark.createDataFrame(list(forms.items()), "form_id string, payload binary"))
    ok, problems = packages.check_packages(entries)
    codes = {}
    for r in problems.collect():
        codes.setdefault(r.form_id, set()).add(r.code)
    assert {r.form_id for r in ok.select("form_id").distinct().collect()} - {"crc"} == {"good"}
    assert codes["late"] == {"BAD_MIMETYPE"} and codes["path"] == {"UNSAFE_PATH"} and codes["none"] == {"MISSING_PART"} and codes["junk"] == codes["empty"] == {"BAD_ZIP"}


def test_nested_tables_and_unsafe_xml(spark):
    xml = b'<s><tbl><tr><tc><cellAddr rowAddr="2" colAddr="1"/><subList><p><run><t>out</t></run><run><tbl><tr><tc><subList><p><run><t>in</t></run></p></subList></tc></tr></tbl></run></p></subList></tc></tr></tbl></s>'
    rows = spark.createDataFrame([("f", "a/section0.xml", xml), ("g", "a/section0.xml", b"<!DOCTYPE x><s/>"), ("h", "a/section0.xml", b"<s>")], "form_id string, path string, content binary")
    cells, runs, problems = packages.parse_sections(rows)
    assert {(r.section, r.table_idx, r.row, r.col, r.text, r.has_nested) for r in cells.collect()} == {("a/section0.xml", 0, 2, 1, "out", True), ("a/section0.xml", 1, 0, 0, "in", False)}
    assert {(r.form_id, r.code) for r in problems.collect()} == {("g", "UNSAFE_XML"), ("h", "BAD_XML")}
    nested = packages.nested_tables(packages.section_parts(rows)).collect()
    assert [(r.table_idx, r.parent_table, r.parent_row, r.parent_col) for r in nested] == [(1, 0, 2, 1)]
    from pyspark.sql import functions as F

    paragraphs = packages.section_paragraphs(packages.section_parts(rows.withColumn("ord", F.lit(3)))).orderBy("seq").collect()
    assert [(r.table_idx, r.row, r.col, r.text) for r in paragraphs] == [(0, 2, 1, "out"), (1, 0, 0, "in")]


def test_sections_of_one_basename_and_foreign_names(spark):
    own = packages.OWN_NAMESPACE + "2011/section"
    xml = f'<sec xmlns="{own}"><p><run><t>x</t></run></p><y:p xmlns:y="urn:y"/></sec>'.encode()
    rows = spark.createDataFrame([("f", "a/section0.xml", xml), ("f", "b/section0.xml", b"<y:p xmlns:y='urn:y'/>")], "form_id string, path string, content binary")
    clashes = packages.ns_clashes(packages.section_elements(packages.section_parts(rows))).collect()
    assert [(r.section, r.local_name) for r in clashes] == [("a/section0.xml", "p")]


def test_packages_are_read_from_files(spark, tmp_path):
    (tmp_path / "one.hwpx").write_bytes(pack(GOOD))
    rows = packages.read_packages(spark, f"{tmp_path}/*.hwpx").collect()
    assert {r.path for r in rows} == {"mimetype", packages.MANIFEST} and rows[0].form_id.endswith("one.hwpx")


def test_sources_are_read_and_tables_written(spark, tmp_path):
    from slotweave.sources import text

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# x\ny")
    (tmp_path / "in" / "b.exe").write_text("z")
    rows = text.read_sources(spark, f"file://{tmp_path}/in")
    assert {(r.kind, r.text, r.error) for r in rows.collect()} == {("md", "# x\ny", None), (None, "z", "UNKNOWN_KIND")}
    text.write_tables({"docs": rows.drop("error")}, f"{tmp_path}/out", by={"docs": ["kind"]})
    assert spark.read.parquet(f"{tmp_path}/out/docs").count() == 2


def test_spine_order(spark):
    items = spark.createDataFrame([("f", "a", "x/section2.xml"), ("f", "b", "x/section0.xml"), ("f", "h", "x/header.xml")], "form_id string, item_id string, path string")
    spine = spark.createDataFrame([("f", 0, "h"), ("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a"), ("f", 4, "zz")], "form_id string, ord int, item_id string")
    entries = spark.createDataFrame([("f", p, b"x") for p in ("x/section2.xml", "x/section0.xml", "x/header.xml")], "form_id string, path string, content binary")
    sections, problems = packages.resolve_spine(items, spine, entries)
    assert [r.path for r in sections.orderBy("ord").collect()] == ["x/section2.xml", "x/section0.xml"]
    assert {(r.item_id, r.code) for r in problems.collect()} == {("a", "DUPLICATE_REF"), ("zz", "BROKEN_REF")}
