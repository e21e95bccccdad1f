from slotweave.operators import extract


def test_blocks_are_lossless_and_ordered(spark):
    texts = {"a": "one\n\nthree", "b": "", "c": "x", "d": "é\n" + "ß" * 7000 + "\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    blocks = extract.with_block_id(extract.with_offsets(extract.line_blocks(docs)))
    rows = {(r.doc_id, r.seq): r for r in blocks.collect()}
    assert [(r.start, r.end, r.text) for k, r in sorted(rows.items()) if k[0] == "a"] == [(0, 3, "one"), (4, 4, ""), (5, 10, "three")]
    assert not [k for k in rows if k[0] == "b"]
    again = {(r.doc_id, r.seq): r.block_id for r in extract.with_block_id(extract.line_blocks(docs)).collect()}
    assert again == {k: r.block_id for k, r in rows.items()}
    parts = extract.split_long_blocks(blocks)
    assert max(len(r.text.encode()) for r in parts.collect()) <= 6000
    assert {r.doc_id: r.text for r in extract.rejoin(parts).collect()} == {k: t for k, t in texts.items() if t}


def test_headings_and_table_positions(spark):
    text = "intro\n# A\n| h1 | h2 |\n|----|----|\n| 1 | 2 |\n| 3 | 4 |\nplain\n| x | y |\n| z | w |"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = extract.blocks_of(docs).orderBy("seq").collect()
    assert [r.heading for r in rows] == [0, 1, 1, 1, 1, 1, 1, 1, 1]
    assert [(r.t_row, r.t_col, r.header, r.is_header) for r in rows] == [
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
        (1, 1, "", False),
        (1, 0, "h1|h2", True),
        (1, 1, "h1|h2", False),
        (None, None, None, None),
        (None, None, None, None),
        (1, 1, "", False),
    ]
    assert rows[4].context == ["h1", "row=1", "col=0", "header=h1|h2"]


def test_status(spark):
    docs = spark.createDataFrame([("a", "txt", "x"), ("b", "pdf", "x"), ("c", "md", None), ("d", "md", ""), ("e", "txt", "y" * 7000), ("f", None, "x")], "doc_id string, kind string, text string")
    out = extract.extract_status(docs, extract.line_blocks(docs))
    assert {r.doc_id: r.status for r in out.collect()} == {"a": "extracted", "b": "unsupported", "c": "failed", "d": "empty", "e": "partial", "f": "unsupported"}


def test_own_text_counts_nested_text_once(spark):
    nodes = spark.createDataFrame([("d", "outer", 0, "a"), ("d", "inner", 1, "b"), ("d", "outer", 2, "c")], "doc_id string, cell_id string, seq int, text string")
    assert {r.cell_id: r.text for r in extract.own_text(nodes).collect()} == {"outer": "ac", "inner": "b"}
