from slotweave.functions.slots import slots
from slotweave.operators import candidates, tables
from slotweave.schemas import CELLS

GRID = [("성명", ""), ("주소", "값"), ("합계", ""), ("※ 안내", "원")]


def grid(spark, rows):
    cells = [("f", "s", 0, r, c, 1, 1, t, False, False) for r, row in enumerate(rows) for c, t in enumerate(row)]
    return spark.createDataFrame(cells, CELLS)


def test_inline_slots():
    assert [(s["label"], s["insert_offset"]) for s in slots("전화 : 팩스 :")] == [("전화", 4), ("팩스", 9)]
    assert slots("전화: 02-1") == [] and slots("※ 전화:") == [] and slots(None) == []
    assert [s["label"] for s in slots("우편 번호: )")] == ["우편번호"]
    assert [s["label"] for s in slots("성명 및 직위:")] == ["성명 및 직위"]


def test_rules_and_precedence(spark):
    cells = grid(spark, [("품명", "금액"), ("성명", ""), ("전화 :", ""), ("합계", ""), ("x", "천원")])
    runs = cells.selectExpr("form_id", "section", "table_idx", "row", "col", "0 AS para", "0 AS run", "text")
    out = {(r.row, r.col): (r.rule, r.editable, r.reason) for r in candidates.form_fields(cells, runs).collect()}
    assert out == {(1, 1): (1, True, None), (2, 0): (4, True, None), (2, 1): (1, True, None), (3, 1): (2, True, None), (4, 1): (3, False, "placeholder")}


def test_spans_and_merges(spark):
    raw = spark.createDataFrame([("f", "s", 0, 0, 0, 2, None), ("f", "s", 0, 0, 1, 1, "restart"), ("f", "s", 0, 1, 0, 2, None), ("f", "s", 0, 1, 1, 1, "continue")], "form_id string, section string, table_idx int, row int, cell_seq int, grid_span int, vmerge string")
    rows = tables.vmerge_groups(tables.grid_columns(raw)).collect()
    assert {(r.row, r.cell_seq): (r.col, r.start_row) for r in rows} == {(0, 0): (0, 0), (0, 1): (2, 0), (1, 0): (0, 1), (1, 1): (2, 0)}


def test_table_scope(spark):
    cells = grid(spark, [("구분", "2024 세입", "2025년", "1999 세출"), ("a", "1", "2", "3"), ("구분", "단위: 원", "", ""), ("b", "4", "", "5")])
    assert sorted((r.start_row, r.end_row) for r in tables.table_sections(cells).collect()) == [(0, 1), (2, 3)]
    assert sorted((r.start_col, r.end_col, r.keyword) for r in tables.regions(cells).collect()) == [(0, 1, "2024 세입"), (1, 3, "1999 세출"), (3, 4, "1999 세출")]
    assert sorted((r.col, r.year) for r in tables.year_columns(cells).collect()) == [(1, 2024), (3, 1999)]
    assert [(r.row, r.col) for r in tables.unit_declarations(cells).collect()] == [(2, 1)]
    assert {(r.row, r.col): r.label for r in tables.table_fields(cells).collect()}[(1, 3)] == "a / 1999 세출"


def test_compound_slots(spark):
    fields = [("a", "주소", "서울특별시 / 04524", None, None, True, "s"), ("b", "시각", "시작 시각 09시 00분 부터 종료 시각 18시 00분 까지", None, None, True, "s"), ("c", "값", "{총사업비}", None, None, True, "s"), ("d", "값", "0", None, None, True, "s"), ("e", "값", "천원", None, None, True, "s"), ("f", "값", "a/b", None, None, False, "s"), ("g", "값", "", None, ["bullet"], True, "s")]
    df = spark.createDataFrame(fields, "id string, label string, original_text string, unit string, context array<string>, editable boolean, status string")
    out = {}
    for r in candidates.split_compound_slots(df).orderBy("id", "part", "subpart").collect():
        out.setdefault(r.id, []).append((r.original_text, r.status))
    assert out["a"] == [("서울특별시", "input"), ("04524", "input")] and len(out["b"]) == 4
    assert out["c"] == [("{총사업비}", "placeholder")] and out["d"] == [("0", "input")] and out["e"] == [("천원", "decoration")]
    assert out["f"] == [("a/b", "s")] and out["g"] == [("", "decoration")]
