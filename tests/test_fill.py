from slotweave.operators import fill, quality, retrieve
from slotweave.schemas import EDITS

RUN = "s", 0, 0, 0, 0, 0
EDIT = "job_id string, field_id string, section string, table_idx int, row int, col int, para int, run int, insert_offset int, value string"


def test_insertions_and_read_back(spark):
    runs = spark.createDataFrame([("j", "f", *RUN, "회원수:  명, 직원:  명"), ("j", "f", "s", 0, 1, 0, 0, 0, "그대로")], "job_id string, form_id string, section string, table_idx int, row int, col int, para int, run int, text string")
    edits = spark.createDataFrame([("j", "a", *RUN, 4, "5"), ("j", "b", *RUN, 12, "100")], EDIT)
    filled = fill.apply_edits(runs, edits)
    assert {r.row: r.new_text for r in filled.collect()} == {0: "회원수:5  명, 직원:100  명", 1: "그대로"}
    assert {(r.field_id, r.read) for r in fill.read_back(filled, edits).collect()} == {("a", "5"), ("b", "100")}
    assert {r.row: r.new_text for r in fill.apply_edits(runs, edits.limit(0)).collect()} == {0: "회원수:  명, 직원:  명", 1: "그대로"}


def test_duplicate_selection_rejects_the_job(spark):
    edits = spark.createDataFrame([("j", 1, "a", "x", True, "user"), ("j", 2, "a", "y", True, "user"), ("k", 1, "a", "x", True, "user"), ("k", 2, "b", "", True, "user"), ("k", 3, "c", "z", False, "user")], EDITS)
    chosen, conflicts = fill.selected_edits(edits)
    assert [(r.job_id, r.field_id) for r in chosen.collect()] == [("k", "a")] and conflicts.count() == 1
    assert {(r.field_id, r.value) for r in fill.latest_edits(edits).filter("job_id = 'j'").collect()} == {("a", "y")}
    report = {r.job_id: r for r in fill.fill_report(edits, chosen).collect()}
    assert (report["k"].n_applied, report["k"].n_skipped, report["j"].n_pending) == (1, 2, 2)


def test_gold_scores(spark):
    gold = spark.createDataFrame([("f", "a", "1"), ("f", "b", None), ("f", "c", "3"), ("f", "gone", "4")], "form_id string, field_id string, expected string")
    actual = spark.createDataFrame([("f", "a", "1", ""), ("f", "b", "changed", ""), ("f", "c", "", "")], "form_id string, field_id string, value string, baseline string")
    row = quality.fill_quality(gold, actual).first()
    assert (row.n_gold, row.n_missing, row.n_miswrite, row.fill_rate) == (4, 2, 1, 0.25)
    found = quality.detection_quality(actual, gold).first()
    assert (found.precision, found.recall) == (1.0, 0.75)


def test_packing_skips_what_does_not_fit(spark):
    rows = [("j", 0, "b1", 60, 1), ("j", 0, "b2", 500, 2), ("j", 0, "b3", 1, 3), ("j", 1, "b1", 60, 1)]
    ranked = spark.createDataFrame(rows, "job_id string, batch int, block_id string, n_bytes long, rank int")
    packed, report = retrieve.pack_blocks(ranked.selectExpr("*", "IF(batch = 0, 100L, 190L) AS field_bytes"), 200)
    assert sorted((r.batch, r.block_id, r["rank"]) for r in packed.collect()) == [(0, "b1", 1), (0, "b3", 3)]
    assert sorted((r.batch, r.n_blocks, r.n_taken, r.n_bytes, r.truncated, r.nothing_fits) for r in report.collect()) == [(0, 3, 2, 161, True, False), (1, 1, 0, 190, True, True)]


def test_ranking_counts_repeated_labels(spark):
    batches = spark.createDataFrame([("j", "d", "f1", 0, "성 명"), ("j", "d", "f2", 0, "성명"), ("j", "d", "f3", 0, "주소")], "job_id string, doc_id string, field_id string, batch int, label string")
    blocks = spark.createDataFrame([("d", 0, "b0", "주소 없음", ["c1"]), ("d", 1, "b1", "성 명: 홍", []), ("d", 2, "b2", "", None)], "doc_id string, seq int, block_id string, text string, context array<string>")
    rows = retrieve.rank_blocks(batches, blocks).orderBy("rank").collect()
    assert [(r.block_id, r.hits) for r in rows] == [("b1", 2), ("b0", 1), ("b2", 0)]
    size = lambda *parts: retrieve.ENTRY + sum(len(p.encode()) for p in parts)
    assert [r.n_bytes for r in rows] == [size("b1", "성 명: 홍"), size("b0", "주소 없음", "c1"), size("b2")]
    assert {r.field_bytes for r in rows} == {size("f1", "성 명") + size("f2", "성명") + size("f3", "주소")}


def test_replace_first_takes_one_edit_a_text(spark):
    elements = spark.createDataFrame([("f", 0, "a"), ("f", 1, "a"), ("g", 0, "a")], "form_id string, seq int, text string")
    edits = spark.createDataFrame([("f", "a", "y"), ("f", "a", "x")], "form_id string, old_text string, value string")
    assert sorted((r.form_id, r.seq, r.text) for r in fill.replace_first(elements, edits).collect()) == [("f", 0, "x"), ("f", 1, "a"), ("g", 0, "a")]


def test_a_failed_check_stops_the_job(spark):
    rows = spark.createDataFrame([("j",), ("k",), ("l",)], "job_id string")
    failed = lambda *j: spark.createDataFrame([(x,) for x in j], "job_id string")
    assert [r.job_id for r in fill.passed_jobs(rows, failed("j", "j"), failed("l")).collect()] == ["k"]
