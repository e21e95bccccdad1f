"""Proof on the XML tree: digests of subtrees, compared from the roots down along the branches that differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.sources.packages import arrow_schema, in_batches
from slotweave.sources.store import release, stored

#: Node rows: path is the element's place among its siblings, from the root down, `/`-joined; parent is that of the element above.
NODES = "form_id string, section string, depth int, path string, parent string, tag string, own binary, text binary, whole binary"
KEY = ["form_id", "section"]


def _digest(*parts: str | bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        data = part.encode() if isinstance(part, str) else part
        h.update(len(data).to_bytes(8, "little") + data)
    return h.digest()


def node_rows(content: bytes) -> Iterator[dict]:
    """A row per element, children first: own is a digest of its tag and attributes (in order of name), text of the texts
    directly in it and behind its children by place, whole of both and of all that it holds."""
    root = ET.fromstring(content)
    todo: list[tuple] = [(root, "0", None, 0, iter(enumerate(root)), [])]
    while todo:
        element, path, parent, depth, rest, below = todo[-1]
        step = next(rest, None)
        if step is not None:
            i, child = step
            todo.append((child, f"{path}/{i}", path, depth + 1, iter(enumerate(child)), []))
            continue
        todo.pop()
        tag = element.tag if isinstance(element.tag, str) else "!"
        own = _digest(tag, *(x for pair in sorted(element.attrib.items()) for x in pair))
        said = [element.text, *(child.tail for child in element)]
        text = _digest(*(x for i, t in enumerate(said) if t for x in (str(i), t)))
        whole = _digest(own, text, *below)
        if todo:
            todo[-1][5].append(whole)
        yield {"depth": depth, "path": path, "parent": parent, "tag": tag.rsplit("}", 1)[-1], "own": own, "text": text, "whole": whole}


def tree_nodes(sections: DataFrame) -> DataFrame:
    """NODES of sections (form_id, path, content); a section that can't be read gives one node of its bytes."""

    def rows(section: dict) -> list[dict]:
        own = {"form_id": section["form_id"], "section": section["path"]}
        try:
            return [own | r for r in node_rows(section["content"])]
        except ET.ParseError:
            raw = _digest(section["content"])
            return [own | {"depth": 0, "path": "0", "parent": None, "tag": "?", "own": raw, "text": raw, "whole": raw}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((row for batch in batches for section in batch.to_pylist() for row in rows(section)), arrow_schema(NODES))

    return sections.select("form_id", "path", "content").mapInArrow(run, NODES)


def tree_changes(old: DataFrame, new: DataFrame, deepest: int = 64) -> DataFrame:
    """(form_id, section, path, tag, kind) of the elements that differ between two sets of NODES (both stored).

    kind: tag or attributes (own), text, added or removed (with all that it holds: its subtree is not gone into). Only
    elements below one whose digest differs are compared: each level reads its own rows and joins those of the branches
    still open. A tree deeper than `deepest` is compared as a whole there.
    """
    found, open_, depth, tables = None, None, 0, []
    while True:
        level = lambda df, side: df.filter(F.col("depth") == depth).select(*KEY, "path", "parent", F.col("tag").alias(f"{side}_tag"), F.col("own").alias(f"{side}_own"), F.col("text").alias(f"{side}_text"), F.col("whole").alias(f"{side}_whole"))  # noqa: B023, E731
        a, b = level(old, "old"), level(new, "new")
        if open_ is not None:
            a, b = (df.join(open_, [*KEY, "parent"], "left_semi") for df in (a, b))
        rows = a.join(b.drop("parent"), [*KEY, "path"], "full").filter(~F.col("old_whole").eqNullSafe(F.col("new_whole")))
        rows = stored(rows, "tree-level")
        tables.append(rows)
        if rows.isEmpty():
            break
        both = F.col("old_whole").isNotNull() & F.col("new_whole").isNotNull()
        kinds = F.when(F.col("old_whole").isNull(), F.array(F.lit("added"))).when(F.col("new_whole").isNull(), F.array(F.lit("removed")))
        kinds = kinds.otherwise(F.array_compact(F.array(F.when(F.col("old_own") != F.col("new_own"), "attributes"), F.when(F.col("old_text") != F.col("new_text"), "text"))))
        here = rows.select(*KEY, "path", F.coalesce("new_tag", "old_tag").alias("tag"), F.explode(kinds).alias("kind"))
        found = here if found is None else found.unionByName(here)
        open_ = rows.filter(both).select(*KEY, F.col("path").alias("parent"))
        depth += 1
        if depth > deepest:
            break
    if found is None:
        return tables[0].select(*KEY, "path", F.col("new_tag").alias("tag"), F.lit("").alias("kind"))
    out = stored(found, "tree-changes")
    for table in tables:
        release(table)
    return out
