"""Inline slots: `label :` with an empty place behind it, inside one text run."""

from __future__ import annotations

import re

import pandas as pd

from slotweave.functions import textfn

#: Labels known to stand before a slot, and the type of what belongs there (fixed values).
LABEL_TYPES = {
    "우편번호": "postal-code",
    "전화": "phone",
    "팩스": "phone",
    "연락처": "phone",
    "이메일": "email",
    "E-Mail": "email",
    "대표전화": "phone",
    "FAX": "phone",
    "성명": "person-name",
    "성명 및 직위": "person-name",
    "직명": "person-name",
    "프로그램명": "text",
    "시설명": "text",
    "주소": "text",
    "등록기관": "text",
    "등록일": "date",
    "설립목적": "text",
    "지원근거및  내용": "text",
    "상근직원수": "number",
    "회원수": "number",
    "홈페이지": "text",
    "사무실(직통)": "phone",
    "휴대전화": "phone",
    "신청사업담당자 전화(휴대폰)": "phone",
}
REQUIRED = re.compile(textfn.REQUIRED)

# One alternation, longer labels first, so each place has the longest label that fits; spaces may stand between characters.
_NAMES = sorted(LABEL_TYPES, key=lambda n: -len("".join(n.split())))
_LABEL = re.compile("|".join(f"(?P<l{i}>" + r"\s*".join(map(re.escape, "".join(n.split()))) + ")" for i, n in enumerate(_NAMES)))
_COLON = re.compile(r"\s*:")
_CLOSING = {")", "]", "}", "）"}


def slots(text: str | None) -> list[dict]:
    """Slots of a run in order: label, insert_offset (behind the colon), unit, required.

    A label counts at its first place only. Its slot is empty if nothing follows the colon but white space, a closing
    bracket, or the next label.
    """
    if not text or text.lstrip().startswith("※"):
        return []
    found = [(m, _NAMES[int(m.lastgroup[1:])]) for m in _LABEL.finditer(text)]
    out, seen = [], set()
    for m, name in found:
        colon = _COLON.match(text, m.end())
        first = name not in seen
        seen.add(name)
        if not first or not colon:
            continue
        at = colon.end()
        rest = text[at:].lstrip()
        nxt = _LABEL.search(text, at)
        labelled = nxt and _NAMES[int(nxt.lastgroup[1:])] != name
        before = text[at : nxt.start()].strip(" \t\r\n()[]{}") if labelled and _COLON.match(text, nxt.end()) else None
        bare = labelled and not text[at : nxt.start()].strip() and (nxt.end() == len(text) or text[nxt.end()].isspace())
        if not rest or before == "" or bare or rest.split()[0] in _CLOSING:
            out.append({"label": name, "insert_offset": at, "unit": LABEL_TYPES[name], "required": bool(REQUIRED.search(name))})
    return out


def slots_series(texts: pd.Series) -> pd.Series:
    return texts.map(slots)


SCHEMA = "array<struct<label:string,insert_offset:int,unit:string,required:boolean>>"
