"""What is needed several times is stored once, so plans stay small however long the chain before them."""

import __spark_entry__ as entry
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "exchanges"), [("s5_section_paragraphs", 2), ("s6_ns_clashes", 2), ("v01_validate_proposals", 20), ("f09_editable_fields", 4), ("g03_guard_edits", 12), ("q05_check_applied", 6)])
def test_plans_do_not_grow_with_the_chain(spark, name, exchanges):
    """No query reads a given table again in its last step, and its shuffles, as they ran, are few."""
    df = entry.queries()[name](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "documents.parquet" not in plan and plan.count("Exchange hashpartitioning") <= exchanges


def test_a_form_is_shuffled_once_for_all_rules(spark):
    from slotweave.operators import candidates
    from slotweave.schemas import CELLS, RUNS

    cells = spark.createDataFrame([("f", "s", 0, 0, 0, 1, 1, "성명", False, False), ("f", "s", 0, 0, 1, 1, 1, "", False, False)], CELLS)
    runs = spark.createDataFrame([("f", "s", 0, 0, 1, 0, 0, "")], RUNS)
    fields = candidates.form_fields(cells, runs)
    assert fields._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.row, r.col, r.rule, r.label, r.unit, r.editable) for r in fields.collect()] == [(0, 1, 1, "성명", "person-name", True)]


@pytest.mark.parametrize("name", ["f01_candidates", "f09_editable_fields", "f16_public_fields", "f17_form_profile", "f18_correct_candidates", "f18_correction_problems", "g05_apply_edits", "q03_diff_fixed", "q05_check_applied", "q06_read_back", "g03_guard_edits", "g03_guard_problems", "g04_overlaps", "q04_diff_protected", "t11_cell_labels", "t12_table_fields"])
def test_cells_are_made_behind_the_shuffle(spark, name):
    """Lines are dealt by form before they become cells; before, cells, labels and runs were shuffled by table and edits joined by place."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert keys and set(keys) <= {"_groupingexpression", "form_id", "job_id"}
    assert "section#" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning(" in line)
    assert "grid-filled-" not in plan and "/fields-" not in plan


def test_joins_of_rows_that_lie_together_match_joins(spark):
    from slotweave.operators import colocated

    left = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", None, "c"), ("g", 2, "d"), (None, 1, "e")], "form_id string, row int, x string")
    right = spark.createDataFrame([("f", 1, "p"), ("f", 1, None), ("f", None, "q"), (None, 1, "r"), ("h", 3, "s")], "form_id string, row int, y string")
    for join in (colocated.left_join, colocated.left_anti):
        one, two = (sorted(map(str, join(left, right, ["form_id", "row"], clustered).collect())) for clustered in (False, True))
        assert one == two and len(one) == (7 if join is colocated.left_join else 3)
