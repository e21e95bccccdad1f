import threading

from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.operators import fill, profile, quality
from slotweave.sources import registry


def test_outline(spark):
    levels = [None, 2, None, 1, 3, 2, None, 3, 4, 2, 1, None]
    rows = spark.createDataFrame([("d", i, v, f"t{i}") for i, v in enumerate(levels)] + [("e", 0, None, "x")], "doc_id string, seq int, level int, title string")
    got = {(r.doc_id, r.seq): (r.parent_seq, list(r.path)) for r in profile.outline(rows).collect()}
    expected = {("e", 0): (None, [])}
    for i in range(len(levels)):
        above, limit = [], levels[i] or 7
        for j in range(i - 1, -1, -1):
            if levels[j] and levels[j] < limit:
                above.insert(0, j)
                limit = levels[j]
        expected["d", i] = (above[-1] if above else None, [f"t{j}" for j in above])
    assert got == expected


def test_table_totals(spark):
    def cells(*rows):
        return [("f", "s", 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]

    rows = cells(
        ("항목", "금액", "비고"), ("a", "1,000", "x"), ("b", "2천원", "9"), ("소계", "3,000", "9"), ("c", "△500", ""), ("소계", "-500", ""), ("합계", "2,501", ""), ("d", "7", ""), ("합계", "7", ""), ("총계", "2,507 원", "10")
    )
    got = quality.table_totals(spark.createDataFrame(rows, "form_id string, section string, table_idx int, row int, col int, text string")).collect()
    assert {(r.row, r.col, r.label, int(r.found), int(r.expected)) for r in got} == {(6, 1, "합계", 2501, 2500), (9, 2, "총계", 10, 9)}


def test_amounts(spark):
    texts = ["1,234", " 12 천원 ", "△3원", "-4", "", "1.5", "원", "12개", None, "9" * 26]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.amount("t")).collect()]
    assert [None if v is None else int(v) for v in got] == [1234, 12000, -3, -4, None, None, None, None, None, int("9" * 26)]


def test_edits_as_of(spark):
    log = [("j", "a", "1", 1, 10), ("j", "a", "2", 2, 10), ("j", "a", "3", 3, 95), ("j", "b", "x", 4, 30), ("k", "a", "y", 5, 1), ("j", "a", "4", 6, 500)]
    shots = [("j", 1, 9), ("j", 2, 10), ("j", 3, 94), ("j", 4, 95), ("j", 5, 499), ("m", 6, 50), ("k", 7, 0)]
    for width in (1, 20, 10_000):
        rows = fill.edits_as_of(spark.createDataFrame(log, "job_id string, field_id string, value string, edit_seq int, at long"), spark.createDataFrame(shots, "job_id string, snapshot_id int, as_of long"), width).collect()
        assert {(r.snapshot_id, r.field_id, r.value) for r in rows} == {(2, "a", "2"), (3, "a", "2"), (3, "b", "x"), (4, "a", "3"), (4, "b", "x"), (5, "a", "3"), (5, "b", "x")}
        assert len(rows) == 7


def _forms(spark, *hashes):
    return spark.createDataFrame([(h, h * 2) for h in hashes], f"{registry.KEY} string, text string")


def test_only_new_forms_are_parsed(spark, tmp_path):
    table = registry.Registry(spark, f"file://{tmp_path}/forms")
    parsed = []

    def parse(new):
        parsed.append({r[registry.KEY] for r in new.collect()})
        return new

    assert table.read() is None
    table.add(_forms(spark, "a", "b", "b"), parse)
    table.add(_forms(spark, "b", "c"), parse)
    table.add(_forms(spark, "a"), parse)
    assert parsed == [{"a", "b"}, {"c"}, set()]
    assert {(r[registry.KEY], r.batch) for r in table.read().collect()} == {("a", 0), ("b", 0), ("c", 1)}
    assert [c["forms"] for c in table.commits()] == [2, 1, 0]


def test_two_writers_of_one_form(spark, tmp_path):
    """Both have read the table before either commits: the second leaves out what the first has added."""
    path, both = f"file://{tmp_path}/forms", threading.Barrier(2)

    def parse(new):
        rows = new.withColumn("x", F.lit(1))
        both.wait(60)
        return rows

    def write(*hashes):
        registry.Registry(spark, path).add(_forms(spark, *hashes), parse)

    writers = [threading.Thread(target=write, args=hashes) for hashes in (("a", "b"), ("b", "c"))]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    rows = registry.Registry(spark, path).read().collect()
    assert sorted(r[registry.KEY] for r in rows) == ["a", "b", "c"] and len(registry.Registry(spark, path).commits()) == 2
