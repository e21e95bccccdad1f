from pyspark.sql import functions as F

from slotweave.functions import textfn as X


def values(spark, expr, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr("t")).collect()]


def test_heading_levels(spark):
    assert values(spark, X.md_level, ["# a", "##", "###### x", "####### y", "#x", "a # b", ""]) == [1, 1, 6, 6, 1, None, None]


def test_table_cells_keep_escaped_pipes(spark):
    assert values(spark, X.md_cells, [r"| a | b\|c |", "|---|:-:|", "| |", ""]) == [["a", r"b\|c"], ["---", ":-:"], [], []]
    assert values(spark, X.is_md_table_row, ["| a | b |", "| a |", "a | b", "|a|b"]) == [True, False, False, False]
    assert values(spark, X.is_md_separator, ["|---|:--|", "| a |---|", "text"]) == [True, False, False]


def test_facts_and_labels(spark):
    assert values(spark, X.facts, ["a: 1, b: 2; c / d", "  ", "one"]) == [["a: 1", "b: 2", "c", "d"], [], ["one"]]
    assert values(spark, X.label_of, ["성명: 홍 길동", "Date 2024", "alone", ": x"]) == ["성명", "Date", "alone", ""]
    assert values(spark, X.value_of, ["성명: 홍 길동", "Date 2024", "alone", "a:b:c"]) == ["홍 길동", "2024", "", "b:c"]
    assert values(spark, X.norm_label, [" E-Mail ", "성 명", None, "A_1!"]) == ["email", "성명", "", "a_1"]


def test_unicode_space_is_stripped(spark):
    assert values(spark, X.strip, ["　a b\x1f "]) == ["a b"]


def test_form_cells(spark):
    texts = ["", "원", "천원 ", "년 월 일", " . . ", "(서명)", "( 열여덟 자를 훌쩍 넘기는 아주 긴 설명 )", "성명", "12,000"]
    assert values(spark, X.is_placeholder, texts) == [False, True, True, True, True, True, False, False, False]
    assert values(spark, X.is_label, ["성명", "※ 안내", "12,000", "원", ""]) == [True, False, False, False, False]
    assert values(spark, X.label_unit, ["우편 번호", "전화", "이메일", "성명", "금액", "년 월 일", "회원수", "비고"]) == ["postal-code", "phone", "email", "person-name", "money", "date", "number", "text"]


def test_year_stands_apart(spark):
    assert values(spark, X.year_of, ["2025 예산", "2025년", "예산(1999)", "12025"]) == [2025, None, 1999, None]


def test_thousand(spark):
    assert values(spark, X.thousand_to_unit, ["3천원", "1,234 천원", "3개", "9" * 36 + "천원", "9" * 35 + "천원"]) == ["3000", "1234000", None, None, "9" * 35 + "000"]


def test_slot_status_and_paragraphs(spark):
    assert values(spark, X.slot_status, ["{값}", "0", "x"]) == ["placeholder", "input", "input"]
    assert values(spark, X.paragraph_status, ["라벨:", "ABC", " ", "본문 문장"]) == ["fixed", "fixed", "empty", "normal"]
    assert values(spark, X.escape_value, ["a<b & c<br/>"]) == ["a&lt;b &amp; c<br/>"]


def test_units(spark):
    row = spark.createDataFrame([(7200,)], "u int").select(X.to_pt("u"), F.round(X.to_mm("u"), 3)).first()
    assert tuple(row) == (72.0, 25.4)


def test_a_slot_label_counts_at_its_first_place_only():
    from slotweave.functions.slots import slots

    assert slots("전화 안내 전화 : ") == [] and [x["label"] for x in slots("전화 : ")] == ["전화"]


def test_strip_takes_what_the_class_takes(spark):
    """Characters of SPACES are those of SPACE, and the ends go as the regular expression has it, at far less cost."""
    every = spark.range(1, 65536).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    found = every.filter(F.col("c").rlike(f"^{X.SPACE}+$")).collect()
    assert {r.c for r in found} == set(X.SPACES)
    texts = ["", " ", "\n a \t b  \n", "　x", "x\x85", "a", None]
    old = lambda c: F.regexp_replace(c, f"^{X.SPACE}+|{X.SPACE}+$", "")
    assert values(spark, X.strip, texts) == values(spark, old, texts)
    assert "regexp" not in str(X.strip("t"))
