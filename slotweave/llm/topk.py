"""Exact top-k inner products by pivot-table elimination.

The pivots are scaled principal directions of a bounded sample, at right angles to one another. Every vector's
distances to them are computed once and kept (the pivot table). With |x| they give x's coordinates along each pivot and
the length of what is left of x, so all pivots together give the greatest lower bound on the distance of a query and
a vector that these distances allow, and with it the upper bound P(q) . P(x) + |rest of q| |rest of x| on their inner
product. A query takes candidates in the order of that bound and stops when the next bound is below its k-th score,
so the result is exact.

Vectors are packed into blocks of about BLOCK_ROWS that share their nearest pivot, queries into blocks of
about QUERY_ROWS. The ranges of coordinates of two blocks bound all their products, so pairs of blocks are eliminated
before their vectors meet. A query's first threshold comes from the SEEDS sampled vectors; a first round searches the
block of greatest bound, and its k-th scores go with the queries into the second round over all other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

PIVOTS = 48
SEEDS = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 512
_NONE = np.iinfo(np.int64).min


def quantised(embeddings: np.ndarray | list, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of each component as a 64-bit integer; missing components of short vectors are 0."""
    out = np.zeros((len(embeddings), dim), np.float64)
    for row, e in zip(out, embeddings, strict=True):
        row[: len(e)] = np.floor(scale * np.asarray(e, np.float64))
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise OverflowError("a scaled component does not fit 64 bits")
    return out.astype(np.int64)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every partial sum is exact there."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[-1]
    if bound >= 2.0**63:
        raise OverflowError("an inner product may not fit 64 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (x.astype(kind) @ q.astype(kind).T).astype(np.int64)


def pivots_of(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Principal directions of a sample, of the sample's mean length; as many as it spans, at most `count`."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    x = sample.astype(np.float64)
    _, strength, directions = np.linalg.svd(x, full_matrices=False)
    kept = directions[: min(count, int((strength > 1e-9 * max(strength[0], 1)).sum()))]
    return kept * max(1.0, np.sqrt((x * x).sum(1)).mean())


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: Euclidean distances of the rows of x to each pivot."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T), 0))


def places(x: np.ndarray, table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Coordinates along each pivot, from the distances, and last the length of what they leave."""
    squares = (x.astype(np.float64) ** 2).sum(1)
    length = np.sqrt((pivots * pivots).sum(1))
    along = (squares[:, None] + (length * length)[None] - table * table) / (2 * length[None])
    rest = np.sqrt(np.maximum(squares - (along * along).sum(1), 0) + 1e-9 * squares)  # room for rounding
    return np.concatenate([along, rest[:, None]], 1)


def box_bound(q_low: np.ndarray, q_high: np.ndarray, x_low: np.ndarray, x_high: np.ndarray) -> np.ndarray:
    """Greatest inner product of places within two boxes (rows: pairs of boxes)."""
    each = np.maximum(np.maximum(q_low * x_low, q_low * x_high), np.maximum(q_high * x_low, q_high * x_high))
    return _roomy(each.sum(1))


def _roomy(bound: np.ndarray) -> np.ndarray:
    return bound + 1e-6 * (1 + np.abs(bound))


def search(q_rows: np.ndarray, q: np.ndarray, q_places: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, x_places: np.ndarray, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Per query (its place) its k best vectors of a block that reach `least`, as ids and scores, ties to the smaller
    id, and how many pairs were evaluated. rows tells a query's own row."""
    upper = _roomy(q_places @ x_places.T)
    reach = np.sqrt((x_places * x_places).sum(1).max(initial=0) * (q_places * q_places).sum(1))
    upper += 1e-9 * reach[:, None]
    out, evaluated = [], 0
    for i, own in enumerate(q_rows):
        live = np.flatnonzero((upper[i] >= least[i]) & (rows != own))
        order = live[np.argsort(-upper[i][live], kind="stable")]
        floor, at, step = least[i], 0, 8 * k
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(order) and upper[i][order[at]] >= floor:
            part = order[at : at + step]
            evaluated += len(part)
            s = scores(x[part], q[i])
            best_s, best_i = np.concatenate([best_s, s[s >= floor]]), np.concatenate([best_i, ids[part][s >= floor]])
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
            if len(best_s) == k:
                floor = max(floor, best_s[-1])
            at, step = at + step, 2 * step
        if len(best_s):
            out.append((i, best_i, best_s))
    return out, evaluated


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """Per query its k highest inner products over every other row: query_id, rank (from 1), vec_id, score.

    embeddings: vec_id long, embedding array<float or double>; a component x counts as floor(scale * x). is_query
    is a condition on vec_id. Ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors that are
    null or empty or hold a null or non-finite component take no part, nor do rows with a null vec_id. Every row is a
    candidate of its own and, if it is a query, gives its own ranks, also where rows repeat a vec_id. Shorter vectors
    are filled up with 0; components or products beyond 64 bits are an error. Other columns are ignored; an empty
    table gives no row.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(good)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("vec_id", "row")), "vectors")
    dim, n_queries = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    seeds = rows.orderBy("h", "row").limit(SEEDS).collect()  # at most SEEDS vectors
    seed_rows = np.array([r.row for r in seeds], np.int64)
    seed_x = quantised([r.embedding for r in seeds], scale, dim)
    pivots = pivots_of(seed_x)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = distances(quantised(pdf["embedding"], scale, dim), pivots)
            yield pdf.assign(cell=table.argmin(1).astype(np.int32), table=list(table))

    kind = rows.schema["embedding"].dataType.simpleString()
    celled = stored(rows.mapInPandas(nearest, f"vec_id long, embedding {kind}, asks boolean, row long, h long, cell int, table array<double>"), "pivot-table")
    sizes = celled.groupBy("cell").agg(F.count("*"), F.sum(F.col("asks").cast("long"))).orderBy("cell").collect()  # at most PIVOTS rows
    parts = {c: (math.ceil(n / BLOCK_ROWS), math.ceil(m / QUERY_ROWS)) for c, n, m in sizes}
    if not n_queries:
        return celled.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("h").alias("score"))

    def numbered(df: DataFrame, of: int) -> DataFrame:
        """df with block: the cell's first number, and a part of the cell by hash."""
        begin = {c: sum(n[of] for b, n in parts.items() if b < c) for c in parts}
        look = lambda d: F.element_at(F.create_map(*[F.lit(v) for kv in d.items() for v in kv]), F.col("cell"))
        return df.withColumn("block", (look(begin) + F.pmod(F.shiftrightunsigned("h", 8), look({c: max(1, n[of]) for c, n in parts.items()}))).cast("int"))

    def pack(pdf: pd.DataFrame, ask: bool) -> pd.DataFrame:
        x = quantised(pdf["embedding"], scale, dim)
        at = places(x, np.stack(pdf["table"]), pivots)
        rows = pdf["row"].to_numpy(np.int64)
        least = np.full(len(rows), _NONE)
        if ask and len(seed_rows) > k:
            least = np.partition(np.where(seed_rows[None] == rows[:, None], _NONE, scores(x, seed_x)), -k, axis=1)[:, -k]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()], "x": [x.tobytes()], "places": [at.tobytes()], "low": [at.min(0)], "high": [at.max(0)], "least": [least.tobytes()], "floor": [int(least.min())]})

    packed = "block int, ids binary, rows binary, x binary, places binary, low array<double>, high array<double>, least binary, floor long"
    blocks = stored(numbered(celled, 0).groupBy("block").applyInPandas(lambda pdf: pack(pdf, False), packed).drop("least", "floor"), "blocks")
    asks = stored(numbered(celled.filter("asks"), 1).groupBy("block").applyInPandas(lambda pdf: pack(pdf, True), packed).withColumnRenamed("block", "q_block"), "queries")

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            upper = box_bound(*(np.stack(pdf[c]) for c in ("q_low", "q_high", "low", "high"))) if len(pdf) else np.zeros(0)
            yield pdf[["q_block", "block"]].assign(upper=upper)[upper >= pdf["floor"].to_numpy(np.float64)]

    every = F.explode(F.sequence(F.lit(0), F.lit(sum(n for n, _ in parts.values()) - 1))).alias("block")
    boxes = asks.select("q_block", F.col("low").alias("q_low"), F.col("high").alias("q_high"), "floor", every).join(blocks.select("block", "low", "high"), "block")
    pairs = boxes.mapInPandas(bounded, "q_block int, block int, upper double")
    pairs = stored(pairs.withColumn("place", F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("upper"), "block"))), "block-pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ints = lambda b: np.frombuffer(b, np.int64)
        wide = lambda b: np.frombuffer(b, np.float64).reshape(-1, len(pivots) + 1)
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, q_rows = ints(r.q_ids), ints(r.q_rows)
                found, _ = search(q_rows, ints(r.q).reshape(-1, dim), wide(r.q_places), ints(r.least), ints(r.rows), ints(r.ids), ints(r.x).reshape(-1, dim), wide(r.places), k)
                if found:
                    n = [len(i) for _, i, _ in found]
                    who = [i for i, _, _ in found]
                    yield pd.DataFrame({"query_row": np.repeat(q_rows[who], n), "query_id": np.repeat(q_ids[who], n), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    def searched(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        q = asks.select("q_block", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("x").alias("q"), F.col("places").alias("q_places"), "least")
        met = pairs.select("q_block", "block").join(q, "q_block").join(blocks.select("block", "ids", "rows", "x", "places"), "block")
        return met.repartition("q_block", "block").mapInPandas(run, "query_row long, query_id long, vec_id long, score long")

    one = stored(searched(asks, pairs.filter("place = 1")), "first-round")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = one.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_row", "score")
    kth = kth.join(celled.filter("asks").select(F.col("row").alias("query_row"), "cell", "h"), "query_row")
    kth = numbered(kth, 1).groupBy("block").agg(F.collect_list(F.struct("query_row", "score")).alias("kth"))  # at most a block's queries

    def raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least = []
            for r in pdf.itertuples():
                known = {} if r.kth is None else {p["query_row"]: p["score"] for p in r.kth}
                old = np.frombuffer(r.least, np.int64)
                least.append(np.maximum(old, [known.get(int(row), _NONE) for row in np.frombuffer(r.rows, np.int64)]).astype(np.int64))
            yield pdf.drop(columns="kth").assign(least=[x.tobytes() for x in least], floor=[int(x.min()) for x in least])

    later = asks.join(kth.withColumnRenamed("block", "q_block"), "q_block", "left").select(*asks.columns, "kth")
    later = stored(later.mapInPandas(raised, asks.schema), "raised-queries")
    rest = pairs.filter("place > 1").join(later.select("q_block", "floor"), "q_block").filter(F.col("upper") >= F.col("floor"))
    scored = one.unionByName(searched(later, rest))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
