"""Quality rules: text statistics, two base rules, and robust multivariate outliers.

Per language and source a minimum-covariance-determinant (MCD) estimate of centre and scatter is fitted to
a transformed statistic vector; texts far from it by Mahalanobis distance are rejected. The fit uses all
rows: a concentration step assigns every row its distance, finds the cut that holds the share H of a
group's rows, and re-estimates from the rows within. Every group has an estimate, which is then drawn towards
that of its language, and this towards that of all, the more the fewer rows it has. Rows are summed where they lie (counts by group and
distance bin, then integer sums and products by group), so a group of any size costs one small partial row
a task, and reruns agree exactly. The start is the median and MAD of each coordinate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small, stored

#: Integer steps of one unit of a transformed coordinate.
SCALE = 1 << 10
#: Standard deviation that a coordinate has at least; many coordinates are 0 for most texts.
FLOOR = {"log_words": 0.3, "log_distinct": 0.1, "log_length": 0.05, "symbols": 0.3, "dup_lines": 0.15, "repeats": 0.15}
DIM = len(FLOOR)
#: Share of rows whose covariance determinant is made least, and number of concentration steps.
H = 0.75
STEPS = 3
#: Rows that the wider estimate counts as beside a group's own; above all rows stands WIDE around their centre.
PRIOR_ROWS = 200
WIDE = {"log_words": 1.5, "log_distinct": 1.2, "log_length": 0.3, "symbols": 0.5, "dup_lines": 0.3, "repeats": 0.3}
#: Chance of rejecting a text whose vector is normal.
ALPHA = 1e-5

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
_LINE = np.ones(256, np.uint8)
_LINE[0x0A] = 0
_LINE_CODE = K.constants(256, 21)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more within their text."""
    key = K.mix(hashes + owner.astype(np.uint64) * K.CODE[2])
    s = np.sort(key)
    return np.isin(key, s[1:][s[1:] == s[:-1]])


def block_counts(block: K.Text) -> np.ndarray:
    """The columns of _COUNTS for each text of a block."""
    n, offsets = len(block), block.offsets
    words = K.split_words(block)
    owner = words.owner()
    hashes = K.word_hashes(block, words, K.CODE)
    at_repeat = np.zeros(len(hashes) + 5, np.int64)
    window, first = K.windows(hashes, words, 5)
    twice = first[_repeats(owner[first], window)]
    np.add.at(at_repeat, twice, 1)
    np.add.at(at_repeat, twice + 5, -1)
    inside = np.cumsum(at_repeat)[: len(hashes)] > 0
    lines = K.split_words(block, _LINE)
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_owner, line_hash = lines.owner()[has_word], K.word_hashes(block, lines, _LINE_CODE)[has_word]
    n_lines = np.bincount(line_owner, minlength=n)
    points = ~K.SPACE[block.data] & ((block.data & 0xC0) != 0x80)
    return np.stack(
        [
            np.diff(words.first),
            _per_text(points, offsets),
            _per_text(_SYMBOL[block.data], offsets),
            n_lines - _distinct(line_owner, line_hash, n),
            np.bincount(owner[inside], minlength=n),
            n_lines,
            _distinct(owner, hashes, n),
        ]
    )


def vectors(c: np.ndarray) -> np.ndarray:
    """Transformed statistic vectors (rows) of the columns of _COUNTS, in integer steps of 1 / SCALE.

    Ratios are shrunk towards an ordinary value by a few pseudo-words or lines, so that short texts do not
    stand out by chance.
    """
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_distinct = c.astype(float)
    x = [
        np.log(n_words + 10),
        np.log(n_distinct + 10),
        np.log((word_chars + 250) / (n_words + 50)),
        np.log1p(20 * n_symbols / (n_words + 50)),
        np.sqrt(n_dup / (n_lines + 10)),
        np.sqrt(n_repeat / (n_words + 50)),
    ]
    return np.round(np.stack(x, 1) * SCALE).astype(np.int32)


def text_counts(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs' columns (text only if asked) with the statistics of every whole text, base_failed and its vector x."""
    rest = [c for c in docs.columns if c != "text" or keep_text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema) + "".join(f", {c} long" for c in _COUNTS) + ", x array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.concatenate([block_counts(b) for b in K.texts(batch.column(batch.schema.get_field_index("text")))], 1)
            x = pa.ListArray.from_arrays(np.arange(0, c.shape[1] * DIM + 1, DIM, dtype=np.int32), pa.array(vectors(c).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], *map(pa.array, c), x], [*rest, *_COUNTS, "x"])

    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return docs.mapInArrow(run, schema).withColumn("base_failed", base)


def chi2_quantile(p: float, dim: int) -> float:
    """Wilson and Hilferty's approximation."""
    return dim * (1 - 2 / (9 * dim) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * dim))) ** 3


def chi2_cdf(x: float, dim: int) -> float:
    return NormalDist().cdf(((x / dim) ** (1 / 3) - 1 + 2 / (9 * dim)) / math.sqrt(2 / (9 * dim)))


#: Makes the scatter of the closest share H of normal rows unbiased.
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, DIM), DIM + 2)


def _group_keys() -> dict:
    return {f"_{c}": F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")}


def _pools() -> dict[str, Column]:
    """The pools of a row: group, language, all."""
    return {"g": F.concat(F.lit("g"), F.length("_lang").cast("string"), "_lang", "_source"), "l": F.concat(F.lit("l"), "_lang"), "a": F.lit("a")}


def _pooled(rows: DataFrame) -> DataFrame:
    """(pool, x): every row once for its language and source, once for its language and once for all."""
    return rows.select(F.explode(F.array(*_pools().values())).alias("pool"), "x")


def _cut(bins: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per keys, the first bin at which the counts n reach the share of all of them."""
    w = Window.partitionBy(*keys)
    reached = bins.withColumns({"run": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)}).filter(F.col("run") >= F.ceil(F.col("total") * share))
    return reached.groupBy(*keys).agg(F.min("bin").alias("cut"))


def _white(scatter: np.ndarray) -> list[float]:
    """The rows of a matrix whose product with a centred vector has the distance as its length."""
    floor = np.diag(np.square(list(FLOOR.values())))
    return np.linalg.inv(np.linalg.cholesky(scatter + floor)).ravel().tolist()


_ESTIMATE = "pool string, n long, centre array<double>, scatter array<double>, white array<double>"


def _estimates(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(pool, n, c.tolist(), s.ravel().tolist(), _white(s)) for pool, n, c, s in rows], columns=["pool", "n", "centre", "scatter", "white"])


def _start(rows: DataFrame) -> DataFrame:
    """Median and MAD of each coordinate, from counts of its integer values."""
    long = rows.select("pool", F.posexplode("x").alias("k", "v"))
    keys = ["pool", "k"]
    middle = _cut(long.groupBy(*keys, F.col("v").alias("bin")).agg(F.count("*").alias("n")), keys, 0.5).withColumnRenamed("cut", "middle")
    middle = small(middle, "quality-middles")  # else every row of a pool would be shuffled by it
    away = long.join(middle, keys).groupBy(*keys, "middle", F.abs(F.col("v") - F.col("middle")).alias("bin")).agg(F.count("*").alias("n"))
    mad = _cut(away, [*keys, "middle"], 0.5)
    per_pool = mad.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("k", "middle", "cut"))).alias("c"))  # DIM entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _estimates([(pool, 0, np.array([e["middle"] for e in c]) / SCALE, np.diag([(1.4826 * e["cut"] / SCALE) ** 2 for e in c])) for pool, c in zip(pdf["pool"], pdf["c"], strict=True)])

    return per_pool.mapInPandas(run, _ESTIMATE)


def _distance(rows: DataFrame, estimates: DataFrame, by: list[str]) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance; null where there is no estimate."""
    away = [F.col("x")[j] / F.lit(float(SCALE)) - F.col("centre")[j] for j in range(DIM)]
    d2 = sum((sum((F.col("white")[i * DIM + j] * away[j] for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(DIM)), F.lit(0.0))
    return rows.join(estimates.select(*by, "centre", "white"), by, "left").withColumn("d2", d2).drop("centre", "white")


def _estimate(rows: DataFrame, before: DataFrame) -> DataFrame:
    """One concentration step: centre and scatter of the closest share H of each pool."""
    near = _distance(rows, before, ["pool"]).withColumn("bin", F.least(F.floor(F.log1p("d2") * 256), F.lit(16383)).cast("int"))
    cuts = _cut(near.groupBy("pool", "bin").agg(F.count("*").alias("n")), ["pool"], H)
    cuts = small(cuts, "quality-cuts")
    pairs = [(i, j) for i in range(DIM) for j in range(i, DIM)]
    x = [F.col("x")[i].cast("long") for i in range(DIM)]
    sums = near.join(cuts, "pool").filter(F.col("bin") <= F.col("cut")).groupBy("pool").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i]) for i in range(DIM)]).alias("s"),
        F.array(*[F.sum((x[i] * x[j]).cast("decimal(38,0)")).cast("double") for i, j in pairs]).alias("p"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pool, n, s, p in zip(pdf["pool"], pdf["n"], pdf["s"], pdf["p"], strict=True):
                centre = np.asarray(s, float) / n / SCALE
                scatter = np.zeros((DIM, DIM))
                for (i, j), v in zip(pairs, p, strict=True):
                    scatter[i, j] = scatter[j, i] = v / n / SCALE**2 - centre[i] * centre[j]
                out.append((pool, int(n), centre, CONSISTENCY * scatter))
            yield _estimates(out)

    return sums.mapInPandas(run, _ESTIMATE)


def drawn(n: int, centre: np.ndarray, scatter: np.ndarray, wide_centre: np.ndarray, wide_scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An estimate of n rows mixed with a wider one that counts as PRIOR_ROWS: centre and scatter of the mixture."""
    own = n / (n + PRIOR_ROWS)
    between = np.outer(centre - wide_centre, centre - wide_centre)
    return own * centre + (1 - own) * wide_centre, own * scatter + (1 - own) * wide_scatter + own * (1 - own) * between


def _shrunk(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """(_lang, _source, centre, white) of every group, drawn towards its language's and that towards all rows'."""
    each = estimates.select("pool", F.struct("n", "centre", "scatter").alias("e"))
    levels = F.array(*[F.struct(F.lit(name).alias("level"), key.alias("pool")) for name, key in _pools().items()])
    known = groups.select("_lang", "_source", F.explode(levels).alias("p")).select("_lang", "_source", "p.level", "p.pool").join(each, "pool")
    groups = known.groupBy("_lang", "_source").agg(*[F.first(F.when(F.col("level") == name, F.col("e")), ignorenulls=True).alias(name) for name in _pools()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(e: dict | None) -> tuple[int, np.ndarray, np.ndarray] | None:
            return None if e is None else (e["n"], np.array(e["centre"], float), np.array(e["scatter"], float).reshape(DIM, DIM))

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                known = of(r["a"])
                if known is None:
                    continue
                n, centre, scatter = known
                centre, scatter = drawn(n, centre, scatter, centre, np.diag(np.square(list(WIDE.values()))))
                for e in (of(r["l"]), of(r["g"])):
                    if e is not None:
                        centre, scatter = drawn(*e, centre, scatter)
                out.append((r["_lang"], r["_source"], centre.tolist(), _white(scatter)))
            yield pd.DataFrame(out, columns=["_lang", "_source", "centre", "white"])

    return groups.mapInPandas(run, "_lang string, _source string, centre array<double>, white array<double>")


_OWN = {*_COUNTS, "x", "base_failed", "distance2", "kept", "d2", "_lang", "_source"}


def fit(rows: DataFrame) -> DataFrame:
    """The estimate of every language and source of rows of text_counts, which are read once."""
    rows = stored(rows.withColumns(_group_keys()).select("_lang", "_source", "base_failed", "x"), "quality-counts")
    passing = stored(_pooled(rows.filter(~F.col("base_failed"))), "quality-vectors")
    estimates = small(_start(passing), "quality-start")
    for step in range(STEPS):
        estimates = small(_estimate(passing, estimates), f"quality-step{step}")
    return small(_shrunk(rows.select("_lang", "_source").distinct(), estimates), "quality-estimates")


def judged(rows: DataFrame, estimates: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """rows of text_counts with distance2 and kept."""
    out = _distance(rows.withColumns(_group_keys()), estimates, ["_lang", "_source"])
    far = F.coalesce(F.col("d2") > chi2_quantile(1 - alpha, DIM), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).withColumnRenamed("d2", "distance2").drop("x", "_lang", "_source")


def quality_rules(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of docs: its columns but text, the statistics of the whole text, base_failed, distance2, kept.

    docs has text, lang and source (strings); any other columns pass through, but for those named like a
    result. base_failed: under 10 words, or over a fifth of the words in 5-word windows that repeat. A text
    that passes is kept unless its squared distance exceeds the chi-squared quantile of 1 - alpha. Rows that
    fail the base rules take no part in the fit. A null language or source is a value of its own; groups of
    few rows are judged mostly by wider estimates (see drawn), and where no row passes, the base rules decide alone.
    Null or empty texts have no words and fail. Repeated rows each count and each give a row; an empty
    table gives none.
    """
    rows = stored(text_counts(docs.select(*[c for c in docs.columns if c not in _OWN])), "quality-rows")
    return judged(rows, fit(rows), alpha)


def passing(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns. Texts are counted again, which moves none of them."""
    clash = [c for c in docs.columns if c in _OWN]
    rows = docs.select("text", "lang", "source")
    estimates = fit(text_counts(rows))
    named = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    return judged(text_counts(named, keep_text=True), estimates, alpha).filter("kept").select(*[F.col(f"__{c}" if c in clash else c).alias(c) for c in docs.columns])
