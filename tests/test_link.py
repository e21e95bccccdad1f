from slotweave.operators import link

FIELDS = "job_id string, doc_id string, field_id string, label string, unit string, title string, section string"
BLOCKS = "doc_id string, seq int, block_id string, text string, title string, section string"


def results(spark, fields, blocks):
    f = spark.createDataFrame(fields, FIELDS)
    return {r.field_id: r for r in link.resolve_links(f, link.link_labels(f, spark.createDataFrame(blocks, BLOCKS))).collect()}


def test_suggested_conflict_missing_and_unit(spark):
    fields = [("j", "d", n, label, unit, None, None) for n, label, unit in [("a", "성명", None), ("b", "금액", "천원"), ("c", "수량", "개"), ("e", "없음", None), ("f", "", None), ("g", "직위", None)]]
    blocks = [("d", 0, "b0", "성명: 홍길동, 금액: 3천원", None, None), ("d", 1, "b1", "수량: 3천원", None, None), ("d", 2, "b2", ": x", None, None), ("d", 3, "b3", "직위: 과장", None, None), ("d", 4, "b4", "직위 부장; 직위: 사장", None, None)]
    out = results(spark, fields, blocks)
    assert (out["a"].status, out["a"].value, out["a"].value_transform, out["a"].source_block_ids) == ("suggested", "홍길동", "extract", ["b0"])
    assert (out["b"].value, out["b"].value_transform) == ("3000", "unit")
    assert (out["c"].value, out["c"].value_transform) == ("3천원", "extract")
    assert out["e"].status == out["f"].status == "missing"
    assert (out["g"].status, out["g"].alternatives, out["g"].value) == ("conflict", ["과장", "부장"], None)


def test_scope(spark):
    fields = [("j", "d", "a", "성명", None, "표1", None), ("j", "d", "b", "성명", None, None, "갑")]
    blocks = [("d", 0, "b0", "성명: 하나", "표1", None), ("d", 1, "b1", "성명: 둘", "표2", "갑"), ("d", 2, "b2", "성명: 셋", None, None)]
    out = results(spark, fields, blocks)
    assert (out["a"].value, out["b"].value) == ("하나", "둘")


def test_table_cells(spark):
    cells = [("d", "예산", None, "t", r * 10 + c, f"b{r}{c}", r, c, label, text) for r, row in enumerate([("인건비", "721", "x"), ("운영비", "9", "y")]) for c, (label, text) in enumerate(zip(("항목", "금액", "비고"), row))]
    cells += [("d", "둘", None, t, 0, f"c{t}", 0, 0, "금액", "5") for t in ("t1", "t2")]
    fields = [("j", "d", "fixed", "인건비", "예산", None, None, 1, True), ("j", "d", "mean", "품명", "예산", None, 1, None, False), ("j", "d", "two", "금액", "둘", None, None, None, False), ("j", "d", "free", "금액", None, None, None, None, False)]
    f = spark.createDataFrame(fields, "job_id string, doc_id string, field_id string, label string, title string, section string, row int, col int, fixed_row boolean")
    c = spark.createDataFrame(cells, "doc_id string, title string, section string, table_id string, seq int, block_id string, row int, col int, col_label string, text string")
    assert {(r.field_id, r.value) for r in link.link_table_cells(f, c).collect()} == {("fixed", "721"), ("mean", "운영비")}


def test_summary_rolls_up(spark):
    rows = spark.createDataFrame([("f", "suggested"), ("f", "missing"), ("g", "conflict")], "form_id string, status string")
    assert {(r.form_id, r.n_fields, r.n_suggested) for r in link.link_summary(rows, "form_id").collect()} == {("f", 2, 1), ("g", 1, 0), (None, 3, 1)}


def test_scope_comes_from_context(spark):
    from slotweave.operators import link

    blocks = spark.createDataFrame([("d", 0, "b0", "이름: 가", ["표: 예산"]), ("d", 1, "b1", "이름: 나", ["구역:뒤", "표:인원"]), ("d", 2, "b2", "이름: 다", [])], "doc_id string, seq int, block_id string, text string, context array<string>")
    fields = spark.createDataFrame([("j", "d", "any", "이름", []), ("j", "d", "title", "이름", ["표: 인원"]), ("j", "d", "both", "이름", ["표: 예산", "구역: 뒤"])], "job_id string, doc_id string, field_id string, label string, context array<string>")
    got = sorted((r.field_id, r.value) for r in link.link_labels(fields, blocks).collect())
    assert got == [("any", "가"), ("any", "나"), ("any", "다"), ("title", "나")]


def test_links_are_found_with_one_shuffle_of_the_blocks(spark):
    from slotweave.operators import link

    blocks = spark.range(5).selectExpr("'d' doc_id", "cast(id as int) seq", "cast(id as string) block_id", "'a: b' text")
    fields = spark.range(5).selectExpr("'j' job_id", "'d' doc_id", "cast(id as string) field_id", "'a' label")
    plan = link.link_labels(fields, blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan  # and a broadcast of the labels asked for
