import io
import zipfile

import pytest
from pyspark.sql import functions as F

from slotweave.operators import grams
from slotweave.sources import filling, packages, store, trees
from slotweave.sources.zipbytes import BadPackage, Package

HEAD = '<s xmlns="urn:x" xmlns:h="urn:y"><h:p/><tbl>'
#: Addresses behind what the cell holds, a nested table, references, a closed text, a run without text and a closed run.
SECTION = (
    HEAD
    + '<tr><tc a="1 &gt; 0"><subList><p><run><t>a&amp;b日本</t></run><run><t/></run></p><p><run></run><run/><run><tbl><tr><tc><subList><p><run><t>in</t></run></p></subList></tc></tr></tbl></run></p></subList><cellAddr rowAddr="0" colAddr="0"/></tc>'
    + "<tc><subList><p><run><t>x<br/>y</t></run><run><t><![CDATA[z]]></t></run></p></subList></tc></tr></tbl></s>"
).encode()


def pack(parts, comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.comment = comment
        for path, content, method in parts:
            z.writestr(zipfile.ZipInfo(path, (2020, 1, 2, 3, 4, 6)), content, method)
    return data.getvalue()


def edit(row, col, para, run, value, offset=None, table=0):
    return {"table_idx": table, "row": row, "col": col, "para": para, "run": run, "insert_offset": offset, "value": value}


def filled(*edits):
    places = filling.RunPlaces(SECTION).places
    return filling.spliced(SECTION, filling.splices(SECTION, places, list(edits))).decode()


@pytest.mark.parametrize(
    ("edits", "old", "new"),
    [
        ([edit(0, 0, 0, 0, "1<2")], "a&amp;b日本", "1&lt;2"),
        ([edit(0, 0, 0, 0, "[", 0), edit(0, 0, 0, 0, "]", 2), edit(0, 0, 0, 0, "!", 5)], "a&amp;b日本", "[a&amp;]b日本!"),
        ([edit(0, 0, 0, 0, "a", 1), edit(0, 0, 0, 0, "b", 1)], "a&amp;", "aab&amp;"),
        ([edit(0, 0, 0, 1, "v")], "<t/>", "<t>v</t>"),
        ([edit(0, 0, 1, 0, "v")], "<run></run><run/>", "<run><t>v</t></run><run/>"),
        ([edit(0, 0, 1, 1, "v", 0)], "<run></run><run/>", "<run></run><run><t>v</t></run>"),
        ([edit(0, 0, 0, 0, "v", table=1)], "<t>in</t>", "<t>v</t>"),
        ([edit(0, 1, 0, 0, "v")], "<t>x<br/>", "<t>v<br/>"),
    ],
)
def test_splices(edits, old, new):
    assert filled(*edits) == SECTION.decode().replace(old, new, 1)


@pytest.mark.parametrize(("edits", "code"), [([edit(9, 0, 0, 0, "v")], "NO_RUN"), ([edit(0, 0, 0, 0, "v", 6)], "BAD_OFFSET"), ([edit(0, 0, 0, 1, "v", 1)], "BAD_OFFSET"), ([edit(0, 1, 0, 1, "v")], "CDATA"), ([edit(0, 0, 0, 0, "v"), edit(0, 0, 0, 0, "w")], "OVERLAP")])
def test_edits_without_a_place(edits, code):
    with pytest.raises(BadPackage, match=code):
        filled(*edits)


def test_other_members_are_copied_as_they_lie():
    old = pack([("mimetype", b"m", 0), ("a.xml", SECTION, 8), ("b.bin", bytes(range(256)) * 9, 8)], b"note")
    new = Package(old).rewritten({"a.xml": b"<s/>"})
    before, after = (zipfile.ZipFile(io.BytesIO(x)) for x in (old, new))
    assert after.testzip() is None and after.comment == b"note" and after.namelist() == before.namelist()
    assert after.read("a.xml") == b"<s/>" and [i.date_time for i in after.infolist()] == [i.date_time for i in before.infolist()]
    raw = lambda data, name: (lambda p: p.packed(next(m for m in p.members if m.path == name))[1])(Package(data))
    assert raw(old, "b.bin") == raw(new, "b.bin")


def test_members_with_sizes_behind_their_data():
    class Stream(io.RawIOBase):  # not seekable, so that the writer puts sizes behind the data
        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += b
            return len(b)

    stream = Stream()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", SECTION)
        z.writestr("b", b"x" * 999)
    new = Package(bytes(stream.data)).rewritten({"b": b"y"})
    z = zipfile.ZipFile(io.BytesIO(new))
    assert z.testzip() is None and z.read("a.xml") == SECTION and z.read("b") == b"y"
    with pytest.raises(BadPackage, match="BAD_ZIP"):
        Package(b"junk")


def test_many_jobs_of_one_form(spark, monkeypatch):
    monkeypatch.setattr(filling, "JOBS", 3)
    forms = spark.createDataFrame([("f", pack([("s", SECTION, 8)])), ("g", b"junk")], "form_id string, payload binary")
    rows = [(f"j{i}", "f", "s", *(edit(0, 0, 0, 0, f"v{i}")[c] for c in filling.PLACE), None, f"v{i}") for i in range(20)]
    rows += [("k", "g", "s", 0, 0, 0, 0, 0, None, "v"), ("m", "f", "none", 0, 0, 0, 0, 0, None, "v"), ("n", "f", "s", 0, 0, 0, 0, 0, 99, "v")]
    edits = spark.createDataFrame(rows, "job_id string, form_id string, section string, table_idx int, row int, col int, para int, run int, insert_offset int, value string")
    made, problems = filling.fill_packages(forms, edits)
    assert {r.job_id: Package(bytes(r.payload)).content("s").decode() for r in made.collect()} == {f"j{i}": SECTION.decode().replace("a&amp;b日本", f"v{i}") for i in range(20)}
    assert {(r.job_id, r.code) for r in problems.collect()} == {("k", "BAD_ZIP"), ("m", "MISSING_PART"), ("n", "BAD_OFFSET")}


def changes(spark, old, new):
    rows = lambda xml: spark.createDataFrame([("f", "s", x.encode()) if isinstance(x, str) else ("f", "s", x) for x in [xml]], "form_id string, path string, content binary")
    nodes = [store.stored(trees.tree_nodes(rows(x)), "nodes") for x in (old, new)]
    return {(r.path, r.tag, r.kind) for r in trees.tree_changes(*nodes).collect()}


def test_tree_changes(spark):
    old = '<s><a x="1" y="2">t<b/>u</a><c><d>v</d></c><e/></s>'
    assert changes(spark, old, '<s ><a y="2" x="1">t<b></b>u</a><c><d>v</d></c><e/></s>') == set()
    assert changes(spark, old, old.replace("v", "w")) == {("0/1/0", "d", "text")}
    assert changes(spark, old, old.replace(">u<", ">U<")) == {("0/0", "a", "text")}
    assert changes(spark, old, old.replace('x="1"', 'x="3"').replace("<e/>", "")) == {("0/0", "a", "attributes"), ("0/2", "e", "removed")}
    assert changes(spark, old, old.replace("<e/>", "<e/><f><g/></f>")) == {("0/3", "f", "added")}
    assert changes(spark, old, "<s>") == {("0", "?", "attributes"), ("0", "?", "text"), ("0/0", "a", "removed"), ("0/1", "c", "removed"), ("0/2", "e", "removed")}


def test_cells_without_addresses_are_placed_by_spans(spark):
    cell = lambda text, rows=1, cols=1: f'<tc><subList><p><run><t>{text}</t></run></p></subList><cellSpan rowSpan="{rows}" colSpan="{cols}"/></tc>'
    xml = f"<s><tbl><tr>{cell('a', 3)}{cell('b', 1, 2)}{cell('c', 2)}</tr><tr>{cell('d')}{cell('e')}</tr><tr>{cell('f', 1, 3)}</tr><tr>{cell('g')}</tr></tbl></s>"
    rows = spark.createDataFrame([("f", "s", xml.encode())], "form_id string, path string, content binary")
    assert {(r.text, r.row, r.col) for r in packages.parse_sections(rows)[0].collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 0, 3), ("d", 1, 1), ("e", 1, 2), ("f", 2, 1), ("g", 3, 0)}


def test_scopes_of_tables(spark):
    xml = "<s><p><run><t>표: one</t></run></p><p><run><tbl><tr><tc><subList><p><run><t>표: no</t></run></p></subList></tc></tr></tbl></run></p><p><run><t> 구역:two </t></run></p><p><run><tbl/></run></p></s>"
    rows = spark.createDataFrame([("f", "a", b"<s><tbl/></s>", 0), ("f", "b", xml.encode(), 1), ("f", "c", b"<s><tbl/></s>", 2)], "form_id string, path string, content binary, ord int")
    found = packages.table_scopes(packages.section_parts(rows), {"title": "표", "section": "구역"}).collect()
    assert {(r.part, r.table_idx, r.title, r.section) for r in found} == {("a", 0, None, None), ("b", 0, "one", None), ("b", 1, "one", "two"), ("c", 0, "one", "two")}


def test_patterns_are_found_by_grams(spark):
    texts = spark.createDataFrame([("d", 1, "abcabd"), ("d", 2, "xxabd"), ("e", 3, "abd"), ("d", 4, None), ("d", 5, "a")], "doc_id string, seq int, text string")
    patterns = spark.createDataFrame([("d", "p", "abd"), ("d", "q", "a"), ("d", "r", "zzz"), ("d", "s", ""), ("e", "t", "cab"), ("d", "u", "cabd"), ("d", "v", None), ("d", "p2", "abd")], "doc_id string, name string, pattern string")
    found = {(r.name, r.seq) for r in grams.containing(patterns, texts, ["doc_id"]).collect()}
    assert found == {("p", 1), ("p2", 1), ("p", 2), ("p2", 2), ("q", 1), ("q", 2), ("q", 5), ("u", 1)}
    some = grams.candidates(patterns.filter("name = 'u'"), texts, ["doc_id"])
    assert some.count() == 1 and some.filter(F.contains("text", "pattern")).count() == 1
