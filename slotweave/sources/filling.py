"""Filled packages: edits as byte splices into the sections of a form, everything else as it was.

A section is parsed incrementally once for all jobs of a form to find where each run's text lies in its bytes; the edits of a
job are spliced in from right to left, and the package is copied with the changed sections only.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.sources.packages import Tables, arrow_schema, in_batches
from slotweave.sources.zipbytes import BadPackage, Package

#: Jobs whose packages one row makes.
JOBS = 64
#: A place of an edit: table, row, column, paragraph and run.
PLACE = ["table_idx", "row", "col", "para", "run"]
_CHAR = re.compile(rb"&[^;]*;|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*")


class RunPlaces:
    """Byte places of the runs' texts of a section, by address.

    places: address to (start, end, form) where the first text of the run stands: form `text` for the bytes inside its
    element up to the first child, `empty` for a closed element `<t/>`, `absent` for a run without one (start is then where
    it may be put). prefix is what names of the section's namespace begin with.
    """

    def __init__(self, data: bytes):
        self.data, self.places = data, {}
        self._tables = Tables()
        self._stack: list[dict] = []
        self._begun: dict | None = None  # an element whose start tag ends at the next event
        parser = expat.ParserCreate()
        parser.buffer_text = False
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        parser.CharacterDataHandler = parser.CommentHandler = lambda _: self._inside()
        parser.ProcessingInstructionHandler = lambda *_: self._inside()
        parser.StartCdataSectionHandler = self._inside
        self._parser = parser
        parser.Parse(data, True)

    def _inside(self) -> None:
        if self._begun is not None:
            self._begun["inner"] = self._parser.CurrentByteIndex
            self._begun = None

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        self._inside()
        name = tag.rsplit(":", 1)[-1]
        at = self._parser.CurrentByteIndex
        above = self._stack[-1] if self._stack else {"name": "", "cell": None}
        node = {"name": name, "tag": tag, "at": at, "cell": above.get("cell"), "count": itertools.count(), "text": None, "child": None}
        if above["name"] == "t" and above["child"] is None:
            above["child"] = at
        if name == "tbl":
            node["table"] = self._tables.table()
        elif name == "tr" and above["name"] == "tbl":
            node["table"] = above["table"].row()
        elif name == "tc" and above["name"] == "tr":
            node |= {"table": above["table"], "spans": (1, 1), "addr": None, "found": []}
            node["cell"] = node
        elif name == "cellAddr" and above["name"] == "tc":  # may stand before or after what the cell holds
            above["addr"] = (int(attributes.get("rowAddr", above["table"].at)), attributes.get("colAddr"))
        elif name == "cellSpan" and above["name"] == "tc":
            above["spans"] = (int(attributes.get("rowSpan", 1)), int(attributes.get("colSpan", 1)))
        elif name == "p" and above["name"] == "subList":
            node["para"] = next(above["count"])
        elif name == "run" and above["name"] == "p" and "para" in above:
            node["run"] = above["para"], next(above["count"])
        self._stack.append(node)
        self._begun = node

    def _end(self, tag: str) -> None:
        at = self._parser.CurrentByteIndex
        node = self._stack.pop()
        closed = node is self._begun and self.data[at - 2 : at] == b"/>"  # the place is then behind the element
        if node is self._begun and not closed:
            node["inner"] = at  # nothing stands between its tags
        self._begun = None
        above = self._stack[-1] if self._stack else None
        if node["name"] == "t" and above and above["name"] == "run" and above["text"] is None:
            above["text"] = (node["at"], at, "empty", tag) if closed else (node["inner"], node["child"] or at, "text", tag)
        if "run" in node and node["cell"]:
            where = node["text"] or ((node["at"], at, "closed", tag) if closed else (at, at, "absent", tag))
            node["cell"]["found"].append((node["run"], where))
        if "found" in node:
            place = node["table"].place(node["addr"], node["spans"])
            self.places.update({(*place, *run): where for run, where in node["found"]})


def _byte_of(raw: bytes, chars: int) -> int:
    """Where a number of characters ends in the bytes of a text; a reference counts as one."""
    at = 0
    for _ in range(chars):
        found = _CHAR.match(raw, at)
        if found is None:
            raise BadPackage("BAD_OFFSET")
        at = found.end()
    return at


def splices(data: bytes, places: dict, edits: list[dict]) -> list[tuple[int, int, bytes]]:
    """(start, end, new bytes) of edits (PLACE, insert_offset, value) in a section; raises where an edit has no place.

    An edit with an offset goes in there; one without replaces the text. edits are in order of place, offset and value,
    and those at one offset stand in that order.
    """
    out = []
    for place, group in itertools.groupby(edits, key=lambda e: tuple(e[c] for c in PLACE)):
        found, some = places.get(place), list(group)
        if found is None:
            raise BadPackage("NO_RUN")
        start, end, form, tag = found
        news = [escape(e["value"]).encode() for e in some]
        if form == "text":
            raw = data[start:end]
            if b"<" in raw:
                raise BadPackage("CDATA")
            for e, new in zip(some, news, strict=True):
                at = (start, end) if e["insert_offset"] is None else (start + _byte_of(raw, e["insert_offset"]),) * 2
                out.append((*at, new))
            continue
        if any(e["insert_offset"] for e in some):
            raise BadPackage("BAD_OFFSET")
        prefix = tag.rsplit(":", 1)[0] + ":" if ":" in tag else ""
        name = f"{prefix}t".encode()
        element = b"<" + name + b">" + b"".join(news) + b"</" + name + b">"
        if form == "closed":  # a run without anything becomes one with a text
            element = data[start:end].rstrip(b"/> \t\r\n") + b">" + element + b"</" + tag.encode() + b">"
        out.append((start, end, element))
    return out


def spliced(data: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """data with the splices applied from right to left; two that overlap are an error."""
    last = len(data)
    for start, end, new in sorted(changes, reverse=True):
        if end > last:
            raise BadPackage("OVERLAP")
        data = data[:start] + new + data[end:]
        last = start
    return data


_EDIT = "struct<section:string,table_idx:int,row:int,col:int,para:int,run:int,insert_offset:int,value:string>"


def fill_packages(forms: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages (job_id, form_id, payload), problems (job_id, form_id, code)).

    forms: form_id, payload; edits: job_id, form_id, section, PLACE, insert_offset, value. A job with an edit that has no
    place (NO_RUN), lies beyond the text (BAD_OFFSET), in a CDATA section (CDATA) or on another (OVERLAP), or whose form
    cannot be read, gives no package. Values are escaped. A form's jobs are dealt JOBS to a row, so that a form that most
    jobs fill is no hot key, and each row reads its form once.
    """
    cut = "job_id string, form_id string, payload binary, code string"

    def made_of(row: dict) -> Iterator[dict]:
        code, package, sections = None, None, {}
        try:
            package = Package(row["payload"])
        except BadPackage as e:
            code = str(e)
        for job in row["jobs"]:
            made, failed = None, code
            try:
                if package is not None:
                    made = _filled(package, sections, job["edits"])
            except BadPackage as e:
                failed = str(e)
            yield {"job_id": job["job_id"], "form_id": row["form_id"], "payload": made, "code": failed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((made for batch in batches for row in batch.to_pylist() for made in made_of(row)), arrow_schema(cut))

    edit = F.struct("section", *PLACE, F.col("insert_offset").cast("int").alias("insert_offset"), "value").cast(_EDIT)
    jobs = edits.groupBy("form_id", "job_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))  # a job's edits
    parts = jobs.groupBy("form_id").agg(F.ceil(F.count("*") / F.lit(JOBS)).alias("parts"))
    jobs = jobs.join(parts, "form_id").withColumn("part", F.pmod(F.xxhash64("job_id"), F.col("parts")))
    rows = jobs.groupBy("form_id", "part").agg(F.collect_list(F.struct("job_id", "edits")).alias("jobs"))  # about JOBS
    made = rows.join(forms.select("form_id", "payload"), "form_id").select("form_id", "payload", "jobs").mapInArrow(run, cut)
    return made.filter("code IS NULL").drop("code"), made.filter("code IS NOT NULL").select("job_id", "form_id", "code")


def _filled(package: Package, sections: dict, edits: list[dict]) -> bytes:
    """A job's package; sections keeps what was read for the jobs before."""
    replaced = {}
    for section, some in itertools.groupby(edits, key=lambda e: e["section"]):
        if section not in sections:
            try:
                data = package.content(section)
                if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                    raise BadPackage("UNSAFE_XML")
                sections[section] = data, RunPlaces(data).places
            except StopIteration:
                raise BadPackage("MISSING_PART") from None
            except (expat.ExpatError, ValueError) as e:
                raise BadPackage(str(e) if isinstance(e, BadPackage) else "BAD_XML") from None
        data, places = sections[section]
        replaced[section] = spliced(data, splices(data, places, list(some)))
    return package.rewritten(replaced)
