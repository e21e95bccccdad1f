"""Column expressions on text; built-in functions only.

White space and word characters follow Unicode, as the rules are written for them, so the classes are spelled
out: Java's \\s is ASCII and Spark's trim strips spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
NON_SPACE = r"[^\s\x1c-\x1f\x85\xa0  -     　]"
NON_WORD = r"[^\p{L}\p{N}_]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of SPACE.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(_c(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return strip(F.coalesce(_c(c), F.lit(""))) == ""


def squeeze(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(_c(c), f"{SPACE}+", "")


def md_level(c: Column | str) -> Column:
    """Heading level 1-6, null for another line; `##` alone is level 1, and no space is needed after the marks."""
    n = F.length(F.regexp_extract(_c(c), r"^(#{1,6})\s*([^\n]+)$", 1))
    return F.when(n > 0, n)


def md_cells(c: Column | str) -> Column:
    """Cells of a table line, trimmed; an escaped pipe stays in its cell."""
    inner = F.regexp_replace(F.regexp_replace(strip(c), r"^\|", ""), r"\|$", "")
    parts = F.transform(F.split(inner, r"(?<!\\)\|", -1), strip)
    return F.when(strip(inner) == "", F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))).otherwise(parts)


def is_md_table_row(c: Column | str) -> Column:
    c = _c(c)
    return c.startswith("|") & (c.endswith("|") | c.endswith("| ")) & (F.size(md_cells(c)) >= 2)


def is_md_separator(c: Column | str) -> Column:
    s = strip(c)
    return s.startswith("|") & s.endswith("|") & F.forall(md_cells(s), lambda x: x.rlike(r"^[:\-]*$"))


def facts(c: Column | str) -> Column:
    """Parts of a line between `,`, `;` and `/`, trimmed, empty ones dropped; none for a blank line."""
    parts = F.transform(F.split(_c(c), f"{SPACE}*[,;/]{SPACE}*", -1), strip)
    return F.filter(parts, lambda x: x != "")


def label_of(c: Column | str) -> Column:
    """What stands before the first colon, else before the first white space, else all."""
    c = _c(c)
    return F.when(F.instr(c, ":") > 0, strip(F.substring_index(c, ":", 1))).otherwise(F.regexp_extract(strip(c), f"^({NON_SPACE}*)", 1))


def value_of(c: Column | str) -> Column:
    """What stands after the first colon, else after the first white space, else nothing."""
    c = _c(c)
    after = F.substr(c, F.instr(c, ":") + 1)
    return F.when(F.instr(c, ":") > 0, strip(after)).otherwise(F.regexp_extract(strip(c), f"(?s)^{NON_SPACE}+{SPACE}+(.*)$", 1))


def norm_label(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(_c(c), F.lit("")))), NON_WORD, "")


# Form cells -----------------------------------------------------------------------------------------------


def is_guidance(c: Column | str) -> Column:
    return strip(c).startswith("※")


def is_total(c: Column | str) -> Column:
    """Row totals, fixed values."""
    return strip(c).isin(*TOTALS)


#: Labels of totals.
TOTALS = ("총계", "합계", "소계", "순계", "계")


def is_placeholder(c: Column | str) -> Column:
    """A cell that holds a placeholder or a unit only (fixed patterns)."""
    return stripped_placeholder(strip(c))


def stripped_placeholder(s: Column) -> Column:
    """is_placeholder of a stripped text."""
    lead = r"[\s()]*"
    tails = "|".join(("", r"원\s*", r"천원\s*", r"년\s*월\s*일\s*", r"\d*\s*\.\s*\d*\s*\.\s*\d*\s*"))
    return (s != "") & (s.rlike(f"^{lead}(?:{tails})$") | ((F.length(s) <= 18) & s.rlike(rf"^{lead}\([^\n]*\)\s*$")))


def is_label(c: Column | str) -> Column:
    s = strip(c)
    return stripped_label(s, stripped_placeholder(s))


def stripped_label(s: Column, placeholder: Column) -> Column:
    """is_label of a stripped text, of which placeholder says whether it is one."""
    return (s != "") & ~s.startswith("※") & ~placeholder & ~s.rlike(r"^[\d\s,.]+$")


def label_unit(c: Column | str) -> Column:
    """Type of a field by its label; the first that fits (fixed words)."""
    c = _c(c)
    return (
        F.when(c.contains("우편"), "postal-code")
        .when(c.rlike("전화|팩스|연락처"), "phone")
        .when(c.rlike("이메일|e-mail"), "email")
        .when(c.rlike("성명|이름"), "person-name")
        .when(c.rlike(r"금액|천원|원\s*$"), "money")
        .when(c.contains("년") & c.contains("월") & c.contains("일"), "date")
        .when(c.contains("회원") | c.rlike(r"(?<![\p{L}\p{N}_])수(?![\p{L}\p{N}_])"), "number")
        .otherwise("text")
    )


def placeholder_unit(c: Column | str) -> Column:
    c = _c(c)
    money = c.contains("천원") | c.rlike(r"원(?![\p{L}\p{N}_])")
    return F.when(money, "money").when(c.rlike(r"년.*월.*일") | c.rlike(r"\d.*\.\s*\d.*\.\s*\d"), "date").otherwise("text")


#: Words of labels whose fields are required (fixed words).
REQUIRED = "성명|주소|우편|전화|이메일|대표|실무|시설명|법인명"


def is_required(c: Column | str) -> Column:
    """Required by the words of the label."""
    return _c(c).rlike(REQUIRED)


def paragraph_status(text: Column | str, control: Column | None = None) -> Column:
    """normal, empty, fixed (at most 12 characters ending in a colon, or at most 4 upper-case) or protected."""
    s = strip(text)
    fixed = (s != "") & ((F.length(s) <= 12) & s.endswith(":") | (F.length(s) <= 4) & (F.upper(s) == s) & (F.lower(s) != s))
    out = F.when(fixed, "fixed").when(s == "", "empty").otherwise("normal")
    return out if control is None else F.when(control, "protected").otherwise(out)


def slot_status(text: Column | str) -> Column:
    """placeholder for `{...}`, else input; a real 0 stays input."""
    return F.when(strip(text).rlike(r"^\{[^}]*\}$"), "placeholder").otherwise("input")


def is_unit_like(c: Column | str) -> Column:
    """A unit alone or a number with one (fixed words)."""
    s = F.lower(strip(c))
    return s.rlike("^(원|천원|만원|달러|유로|명|개|건|회|부|각형)$") | s.rlike(r"^\d+\s*(원|천원|만원|달러|유로|명|개|건|회|부)$")


def year_of(c: Column | str) -> Column:
    """A year 19xx or 20xx that stands apart: `2025년` has none."""
    found = F.regexp_extract(_c(c), r"(?<![\p{L}\p{N}_])(19\d{2}|20\d{2})(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found.cast("int"))


def is_unit_declaration(c: Column | str) -> Column:
    return F.lower(F.coalesce(_c(c), F.lit(""))).rlike("단위|천원|원|주:|참고:")


def thousand_to_unit(c: Column | str) -> Column:
    """Digits before 천원 times 1000, as text; null where there is none or it has over 35 digits."""
    digits = F.regexp_replace(F.regexp_extract(_c(c), r"([\d,]+)\s*천원", 1), ",", "")
    return F.when((digits != "") & (F.length(digits) <= 35), (digits.cast("decimal(35,0)") * 1000).cast("decimal(38,0)").cast("string"))


def escape_value(c: Column | str) -> Column:
    """Markup-escaped text; `<br/>` stays."""
    out = F.replace(_c(c), F.lit("<br/>"), F.lit("\u0001"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.replace(out, F.lit("\u0001"), F.lit("<br/>"))


def to_pt(c: Column | str) -> Column:
    """Layout units to points: 100 a point."""
    return _c(c) / F.lit(100.0)


def to_mm(c: Column | str) -> Column:
    """Layout units to millimetres: 7200 an inch."""
    return _c(c) / F.lit(7200.0) * F.lit(25.4)


def amount(c: Column | str) -> Column:
    """An amount of money in whole units: digits with or without commas, a sign before, 원 or 천원 (a thousand) behind; else null."""
    s = strip(c)
    found = s.rlike(r"^[-△]?\d[\d,]{0,27}\s*(천원|원)?$")
    number = F.regexp_replace(s, r"[^\d]", "").cast("decimal(28,0)")
    signed = F.when(s.rlike("^[-△]"), -number).otherwise(number)
    return F.when(found, F.when(s.endswith("천원"), (signed * 1000).cast("decimal(32,0)")).otherwise(signed.cast("decimal(32,0)")))
