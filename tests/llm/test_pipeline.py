import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "re", "ton", "li", "sa", "mu") for b in ("ka", "ne", "rol", "ti", "do", "vi", "sh")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    shared = text(70)
    rows = [(i, text(120), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1] + " end", "en", "s0"), (101, text(60) + " " + shared, "en", "s1"), (102, text(200) + " " + shared, "en", "s1"), (103, "too short", "en", "s0"), (None, text(50), "en", "s2"), (104, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in out} for name, out in seen.items()}
    assert {103, 104} & ids["quality_rules"] == set() and {*range(60), None} <= ids["quality_rules"]
    assert all(None in ids[name] for name in ("near_duplicates", "substring_dedup", "source_mixing"))
    assert 100 not in ids["near_duplicates"] and ids["near_duplicates"] == ids["quality_rules"] - {100}
    cut = {r.doc_id: r for r in seen["substring_dedup"]}
    assert shared in cut[101].text and shared not in cut[102].text and cut[102].n_chars == len(cut[102].text)
    assert ids["source_mixing"] <= ids["substring_dedup"] and all(r.round_trip for r in seen["sentencepiece"])
    assert len(seen["sentencepiece"]) == len(seen["source_mixing"])


def test_odd_rows_and_an_empty_table(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names go through all stages; so does no row."""
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    for c in ("spans", "text_key", "position", "positions", "rows", "d2", "xs"):
        docs = docs.withColumn(c, F.lit("clash"))
    for kind, table in (("odd", docs), ("none", docs.limit(0))):
        names = table.columns
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / kind / name)
            stage(spark, table, "").write.parquet(path)
            table = spark.read.parquet(path)
            if name != "sentencepiece":
                assert table.columns == names
        assert {r.doc_id for r in table.collect()} <= {1, 8} and (kind == "odd") == (table.count() > 0)
