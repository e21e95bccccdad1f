import random
import re
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slotweave.llm import kernels as K
from slotweave.llm import langid, token_count, unigram
from slotweave.llm.quality import _COUNTS, block_counts, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["ab", "Ab", "c", "日本", "é", "#", "%%%", "\n", "\n\n", "  ", "\t", "\x0b", "don't", "12", "<|endoftext|>", "\x1c", " ", "▁", "😀"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(n)]


def test_words_match_the_pattern():
    texts = random_texts(60)
    for limit in (1, 50, 1 << 20):
        got = []
        for block in K.texts(pa.array(texts), limit):
            w = K.split_words(block)
            spans = [block.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
            got += [spans[i:j] for i, j in zip(w.first[:-1], w.first[1:])]
        assert got == [WORD.findall(t) for t in texts]


def test_quality_counts_match_brute_force():
    texts = random_texts(80, 2) + ["a b c d e " * 4, "x\nx\n \n x"]
    rows = [dict(zip(_COUNTS, map(int, c))) for b in K.texts(pa.array(texts)) for c in block_counts(b).T]
    for text, row in zip(texts, rows, strict=True):
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, inside, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if count[x] > 1:
                inside.update(range(i, i + 5))
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def test_token_counts_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = random_texts(120, 3) + ["a " * 30_000]
    expected = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.PieceCounts(path).count(texts) == expected


def test_token_count_rows(spark, odd_docs):
    rows = token_count.token_counts(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), 512).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert (by[2].n_bytes, by[2].n_tokens, by[3].n_bytes, by[3].n_tokens) == (0, 0, 0, 0) and by[4].over_limit and not by[1].over_limit
    assert token_count.token_counts(odd_docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_lines_and_words_past_64_kib_are_told_apart():
    a, b = "a" * 65536, "b" * 65536
    rows = [dict(zip(_COUNTS, map(int, c))) for block in K.texts(pa.array([f"{a}{b}\n{b}{a}", f"{a}{b}\n{a}{b}"])) for c in block_counts(block).T]
    assert [r["n_dup_lines"] for r in rows] == [0, 1] and [r["n_distinct"] for r in rows] == [2, 1]


def test_estimates_match_plain_concentration(spark):
    """MCD by the same steps in numpy, over rows in memory."""
    import numpy as np

    from slotweave.llm import quality as Q

    rng = np.random.default_rng(3)
    x = np.round(rng.multivariate_normal(np.arange(6), np.diag(np.arange(1, 7) / 3.0), 500) * Q.SCALE).astype(int)
    x[:20] += 40 * Q.SCALE
    pooled = spark.createDataFrame([("p", v.tolist()) for v in x], "pool string, x array<int>")
    got = Q._start(pooled)
    for _ in range(Q.STEPS):
        got = Q._estimate(pooled, got)
    got = got.first()
    y = x / Q.SCALE
    low = lambda v: np.sort(v, 0)[int(np.ceil(0.5 * len(v))) - 1]
    centre = low(y)
    scatter = np.diag((1.4826 * low(np.abs(y - centre))) ** 2)
    for _ in range(Q.STEPS):
        white = np.array(Q._white(scatter)).reshape(6, 6)
        bins = np.minimum(np.floor(np.log1p((((y - centre) @ white.T) ** 2).sum(1)) * 256), 16383)
        near = y[bins <= np.sort(bins)[int(np.ceil(Q.H * len(y))) - 1]]
        centre, scatter = near.mean(0), Q.CONSISTENCY * np.cov(near.T, bias=True)
    assert got.n == len(near) and np.allclose(got.centre, centre) and np.allclose(np.array(got.scatter).reshape(6, 6), scatter, atol=1e-6)


def test_quality_rows(spark, odd_docs):
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.kept for r in rows if r.doc_id} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert quality_rules(odd_docs.limit(0)).count() == 0


def test_quality_rejects_outliers(spark):
    rng = random.Random(4)
    words = ["the", "river", "runs", "down", "over", "stones", "and", "meets", "a", "wide", "calm", "lake", "again", "today"]
    clean = [(i, " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(40, 200))), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(rng.choice(words) + "###$$" for _ in range(80)), "en", "s") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[1000 + i] for i in range(5)) and sum(kept[i] for i in range(400)) >= 398


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_unigram_finds_best_segmentation(path):
    v = unigram.vocabulary(path)
    piece = {t.decode().replace(" ", "▁"): i for i, t in enumerate(v.text) if len(t) > 0 and i > 258}

    def best(s):
        scores = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 16), j):
                if s[i:j] in piece:
                    scores[j] = max(scores[j], scores[i] + v.score[piece[s[i:j]]])
                elif j == i + 1:
                    scores[j] = max(scores[j], scores[i] + v.unknown)
        return scores[-1]

    words = ["thaninble", "the", "über", "日本語", "x\x00y", "1234", "don't", "aaaaaaaa", "ingly"]
    flat, at = unigram.segment(v, [("▁" + w).encode() for w in words])
    for w, i, j in zip(words, at[:-1], at[1:]):
        ids = flat[i:j]
        assert b"".join(v.text[p] for p in ids).decode() == " " + w
        if not any(p < 259 for p in ids):
            assert abs(sum(v.score[p] for p in ids) - best("▁" + w)) < 1e-6


def test_log_scores_give_about_the_pieces_of_the_library(path):
    import pyarrow.parquet as pq
    import sentencepiece

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    _, offsets = unigram.encode(unigram.vocabulary(path), texts)
    library = sum(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)))
    print(offsets[-1] / library)
    assert abs(offsets[-1] / library - 1) < 0.05


def test_long_words_are_segmented_like_short_ones(path, rng, monkeypatch):
    v = unigram.vocabulary(path)
    words = ["".join(rng.choice(["ing", "the", "a", "日本", "é", "😀", "0"]) for _ in range(n)).encode() for n in (3, 60, 200)]
    expected = unigram.segment(v, words)
    monkeypatch.setattr(unigram, "LONG_WORD", 1)
    for x, y in zip(expected, unigram.segment(v, words), strict=True):
        assert x.tolist() == y.tolist()
    monkeypatch.undo()
    text = "日本語" * 30_000 + "aaab" * 30_000
    pieces, offsets = unigram.encode(v, [text])
    assert unigram.decode(path, pieces, offsets) == [text]


def test_unigram_round_trip(path, spark, odd_docs):
    v = unigram.vocabulary(path)
    texts = random_texts(100, 6) + ["", "  a  b ", "▁"]
    pieces, offsets = unigram.encode(v, texts)
    assert unigram.decode(path, pieces, offsets) == [t.replace("▁", " ") for t in texts]
    rows = unigram.encode_texts(odd_docs, path).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[3] == 0
    back = {r.doc_id: r.text for r in unigram.decode_texts(unigram.encode_texts(odd_docs, path), path).collect()}
    assert back[8] == "A B c d e f g h i j K" and back[3] == ""


def test_cross_parsing_matches_brute_force(rng):
    def parse(train, text):
        n = 0
        for at in range(0, len(text), langid.STRETCH):
            part, i = text[at : at + langid.STRETCH], 0
            while i < len(part):
                j = i + 1
                while j < len(part) and part[i : j + 1] in train:
                    j += 1
                i, n = j, n + 1
        return n

    import numpy as np

    han = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    sample = {k: ["".join(rng.choice(a) for _ in range(200))] for k, a in (("x", "abcd "), ("y", "bcde "), ("z", han))}
    model = langid.fit(sample)
    texts = ["".join(rng.choice("abcdeq ") for _ in range(n)) for n in (0, 1, 50, 256, 257, 700)]
    texts += [sample["z"][0][20:90] + han[:200]]
    points = [langid.letters(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in points])))
    got = langid.phrases(model, model.symbol[np.concatenate(points)], offsets)
    known = [t.replace("q", "\0") for t in texts]
    assert got.tolist() == [[parse(sample[k][0], t) for k in model.langs] for t in known]


def test_every_language_is_learned_from_whole_texts(spark):
    """More than 200 languages, characters past any fixed alphabet, and words that only stand late in a text."""
    rng = random.Random(19)
    rows = []
    for k in range(210):
        own = ["".join(chr(0x4E00 + 90 * k + rng.randrange(90)) for _ in range(4)) for _ in range(20)]
        rows += [(10 * k + n, ("x " * 3000 if n < 9 else "") + "".join(rng.choice(own) for _ in range(40)), f"l{k:03}") for n in range(10)]
    out = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    right = {r.doc_id: r.lang_pred == f"l{r.doc_id // 10:03}" for r in out.filter("doc_id % 10 = 9").collect()}
    assert len(right) == 210 and sum(right.values()) >= 205


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    rates = {r.lang: r.rate for r in out.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("rate")).collect()}
    print(rates)
    assert min(rates.values()) >= 0.99


def test_signs_and_short_samples_decide_nothing(spark):
    """Signs in the sample of one language only, and a language with a tenth of the others' labelled text."""
    rng = random.Random(4)
    own = {lang: ["".join(rng.choice(signs) for _ in range(rng.randrange(2, 8))) for _ in range(400)] for lang, signs in (("aa", "abcdeimnorst"), ("bb", "aehiklmnopuw"), ("cc", "abdeghiklrst"))}
    rows = []
    for i in range(900):
        lang = "aa" if i % 30 == 0 else ("bb", "cc")[i % 2]
        text = " ".join(rng.choice(own[lang]) for _ in range(60))
        if lang == "bb" or i > 600:
            text = text.replace(" ", " %%% *** $$ !! ")
        rows.append((i, text, lang))
    out = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    right = [r.lang_pred == rows[r.doc_id][2] for r in out]
    assert sum(right) >= 0.99 * len(right)
    long = [(i, "x" * 50 + " " + "y z " * 400_000, "aa") for i in range(4)]
    assert {r.lang_pred for r in langid.identify_languages(spark.createDataFrame(long, "doc_id long, text string, lang string")).collect()} == {"aa"}


def test_language_rows(spark, odd_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "was"] if i % 2 else ["der", "und", "nicht", "ein"]) for _ in range(30)), "en" if i % 2 else "de") for i in range(100)]
    out = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in out) and {r.held_out for r in out} == {True, False}
    odd = langid.identify_languages(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r.lang_pred for r in odd if r.doc_id in (2, 3, 6)} == {"und"}
    assert langid.identify_languages(odd_docs.limit(0)).count() == 0
