"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of m sub-keys each, a sub-key being WIDTH minhashes, give m * m table keys: key (i, j)
combines sub-key i of the first with sub-key j of the second. Plain banding with keys of 2 * WIDTH minhashes
would need a new set of minhashes per table; here 2 * m * WIDTH minhashes serve m * m tables. A pair of
similarity s meets in some table with probability (1 - (1 - s ** WIDTH) ** m) ** 2; m follows from the
threshold and MISS.

1. Texts with equal shingle sets form a class; one document, the smallest id, stands for it.
2. Sub-keys held by one class only are left out before keys are combined (they can meet nobody).
3. In each table key the smallest class is the leader, and members are compared with it on full shingle sets,
   recomputed from both texts. So a group of n copies costs about n comparisons.
4. Classes that meet, linked or not, form a family. Most families are one component by now. In the others every link
   is found exactly: members of a family of at most SMALL_FAMILY are compared across components; in larger ones
   members are described by what they differ in from the family's core, which is short where they are alike, and a
   prefix filter over these differences gives the pairs that may still be linked (see _differences and _probes).
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import release, small, stored, stored_rows_of

SHINGLE = 5
WIDTH = 3
#: Bound on the chance that a pair at the threshold meets in no table.
MISS = 1e-4
#: Members of which a family's core is taken, about.
CORE_SAMPLE = 15
#: Members of a family that are compared without a filter.
SMALL_FAMILY = 16
#: Classes of differences by their size, at most.
BINS = 64


def collections_of(percent: int) -> int:
    """Sub-keys per collection so that a pair at the threshold is missed with a chance of at most MISS."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** WIDTH))


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a column."""
    for block in K.texts(column):
        words = K.split_words(block)
        hashes, at = K.windows(K.word_hashes(block, words), words, size, whole_if_short=True)
        bounds = np.searchsorted(at, words.first)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            s = np.sort(hashes[i:j])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    return K.constants(n, 31)[:, None], K.constants(n, 32)[:, None]


def minhashes(s: np.ndarray, n: int) -> np.ndarray:
    """Minima of n linear permutations over a set of hashes, in slices so that memory stays bounded."""
    a, b = _permutations(n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1 << 14):
        np.minimum(out, (a * s[None, i : i + (1 << 14)] + b).min(1), out=out)
    return out


_SLOT = K.constants(256, 33)


def sub_keys(s: np.ndarray, m: int) -> np.ndarray:
    """2 * m sub-keys; the slot is mixed in, so equal keys come from equal slots."""
    parts = K.mix(minhashes(s, 2 * m * WIDTH)).reshape(2 * m, WIDTH)
    acc = _SLOT[: 2 * m].copy()
    for k in range(WIDTH):
        acc = K.mix(acc + parts[:, k])
    return acc.view(np.int64)


def features(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null when empty) and sub_keys of every row."""
    m = collections_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(sub_keys(s, m) if len(s) else np.zeros(0, np.int64))
            if not sizes:
                continue
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))],
                ["doc_id", "n_shingles", "set_key", "sub_keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sub_keys array<long>")


def _paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with both texts behind."""
    first, second = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")


def compared(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """For pairs (a, b): the sizes of both full shingle sets, n_a and n_b, and whether they reach the threshold (linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, linked = [], [], []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if _may_fit(len(x), len(y), percent) else 0
                n_a.append(len(x))
                n_b.append(len(y))
                linked.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "n_a", "n_b", "linked"])

    return _paired(pairs, texts).mapInArrow(run, "a long, b long, n_a long, n_b long, linked boolean")


def _may_fit(x, y, percent: int):
    """Two sets whose sizes differ by more cannot reach the threshold."""
    return (100 * x >= percent * y) & (100 * y >= percent * x)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _table_keys(classes: DataFrame, m: int) -> DataFrame:
    """(key, rep): the table keys of each class, from the sub-keys that another class holds too."""
    held = classes.select("set_key", "rep", F.posexplode("sub_keys").alias("slot", "sub"))
    shared = small(held.groupBy("sub").agg(F.count("*").alias("n")).filter("n > 1").select("sub"), "shared-sub-keys")
    side = lambda of: F.collect_list(F.when(of, F.col("sub")))  # noqa: E731  at most m entries
    some = held.join(shared, "sub").groupBy("set_key", "rep").agg(side(F.col("slot") < m).alias("p"), side(F.col("slot") >= m).alias("q"))
    return some.filter((F.size("p") > 0) & (F.size("q") > 0)).select("rep", F.explode("p").alias("p"), "q").select("rep", "p", F.explode("q").alias("q")).select(F.xxhash64("p", "q").alias("key"), "rep")


def _star(tables: DataFrame) -> DataFrame:
    """(a, b): each key's smallest class with the others."""
    leader = tables.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select("key", "a")
    return tables.join(leader, "key").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def _open_members(pairs: DataFrame, families: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, family, root, n, size): members of the families that lie in several components, and the family's size."""
    nodes = pairs.select(F.col("a").alias("doc_id"), F.col("n_a").alias("n")).union(pairs.select("b", "n_b")).distinct()
    nodes = nodes.join(families.select(F.col("node").alias("doc_id"), F.col("root").alias("family")), "doc_id")
    nodes = nodes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    nodes = stored(nodes, "family-members")
    sizes = nodes.groupBy("family").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("size > 2 AND lo < hi").select("family", "size")
    return stored(nodes.join(small(sizes, "open-families"), "family"), "open-members")


def _across(members: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small families in different components, but for those that have been compared."""
    x, y = (members.select("family", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "root")]) for s in "xy")
    pairs = x.join(y, "family").filter((F.col("root_x") < F.col("root_y")) & _may_fit(F.col("n_x"), F.col("n_y"), percent))
    return pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct().join(star, ["a", "b"], "left_anti")


def _cores(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(family, core): the shingles that most of about CORE_SAMPLE members of the family's largest component hold.

    Any core keeps the results right; one that most members share makes their differences short and unlike.
    """
    parts = members.groupBy("family", "root").agg(F.count("*").alias("part"))
    main = small(parts.groupBy("family").agg(F.max(F.struct("part", "root")).alias("m")).select("family", F.col("m.root").alias("root"), F.col("m.part").alias("part")), "main-parts")
    sample = members.join(main, ["family", "root"]).filter(F.pmod(F.xxhash64("doc_id"), F.col("part")) < CORE_SAMPLE)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([s.view(np.int64) for s in shingle_sets(batch.column(1))])], ["family", "d"])

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = []
            for row in batch.column(1):
                found, count = np.unique(row.values.flatten().to_numpy(zero_copy_only=False), return_counts=True)
                cores.append(found[2 * count > len(row.values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(cores)], ["family", "core"])

    held = sample.join(texts, "doc_id").select("family", "text").mapInArrow(sets, "family long, d array<long>")
    return held.groupBy("family").agg(F.collect_list("d").alias("ds")).mapInArrow(core, "family long, core array<long>")


def _differences(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """members (doc_id, family, root, n) with d, what their set and the family's core do not share, and g.

    For members x and y with sets X and Y, the symmetric difference of X and Y is that of Dx and Dy. With
    G = (100 + p) |D| - (100 - p) |X| they are linked exactly if they share at least (Gx + Gy) / (2 (100 + p)) entries
    of Dx and Dy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for s, c in zip(shingle_sets(batch.column(4)), batch.column(3), strict=True):
                n.append(len(s))
                out.append((np.setxor1d(s, np.sort(c.values.to_numpy().view(np.uint64)), assume_unique=True) if c.is_valid else s).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), _lists(out)], ["doc_id", "family", "root", "n", "d"])

    cores = small(_cores(members, texts), "cores", 200)
    rows = members.select("doc_id", "family", "root").distinct().join(cores, "family", "left").join(texts, "doc_id").select("doc_id", "family", "root", "core", "text")
    rows = rows.mapInArrow(run, "doc_id long, family long, root long, n long, d array<long>")
    return rows.withColumn("g", (100 + percent) * F.size("d").cast("long") - (100 - percent) * F.col("n"))


def _shared_entries(rows: DataFrame) -> DataFrame:
    """rows with e: the entries of d that another member of the family holds too, those of fewest members first."""
    each = rows.repartition(F.xxhash64("doc_id", "n")).select("family", "doc_id", "root", "n", "g", F.explode("d").alias("e"))
    often = each.groupBy("family", "e").agg(F.count("*").alias("df")).filter("df > 1")
    lists = each.join(often, ["family", "e"]).groupBy("family", "doc_id", "root", "n", "g").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    return lists.select("family", "doc_id", "root", "n", "g", F.col("s.e").alias("e"))


def _probes(rows: DataFrame, percent: int) -> DataFrame:
    """(family, entry, lo, hi, bin, doc_id, root, n): the entries under which a member looks for partners of each bin.

    Members of a family fall into bins by g. To be linked, a member x and one of another bin must share at least
    `need` entries, by x's own g and the least g of that bin; so one of those they share is among the first
    |e| - need + 1 of each, and bins for which `need` exceeds what can be shared are left out.
    """
    t = 2 * (100 + percent)
    rows = stored(rows.withColumn("u", F.size("e")), "shared-entries")
    span = small(rows.groupBy("family").agg(F.min("g").alias("g0"), F.max("g").alias("g1")), "spans")
    step = F.greatest(F.lit(2 * t).cast("long"), F.ceil((F.col("g1") - F.col("g0") + 1) / BINS))
    rows = rows.join(span, "family").withColumn("bin", F.floor((F.col("g") - F.col("g0")) / step).cast("int")).drop("g0", "g1")
    bins = rows.groupBy("family", "bin").agg(F.min("g").alias("least"), F.max("u").alias("most"))
    bins = small(bins.groupBy("family").agg(F.collect_list(F.struct("bin", "least", "most")).alias("bins")), "bins")  # at most BINS + 1 entries
    needs = F.transform("bins", lambda b: F.struct(b.bin.alias("bin"), F.greatest(F.lit(1).cast("long"), F.ceil((F.col("g") + b.least) / t)).alias("need"), b.most.alias("most")))
    fits = F.filter(needs, lambda b: b.need <= F.least(F.col("u"), b.most))
    some = rows.join(bins, "family").select("family", "doc_id", "root", "n", "bin", "e", "u", F.explode(fits).alias("b"))
    first = (F.col("u") - F.col("b.need") + 1).cast("int")
    return some.select("family", F.least("bin", "b.bin").alias("lo"), F.greatest("bin", "b.bin").alias("hi"), "bin", "doc_id", "root", "n", F.explode(F.slice("e", F.lit(1), first)).alias("entry"))


def _in_large_families(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of large families."""
    rows = stored(_differences(members, texts, percent), "differences")
    centre = rows.groupBy("family").agg(F.min(F.struct("g", "doc_id", "root")).alias("c")).select("family", F.col("c.g").alias("c_g"), F.col("c.doc_id").alias("c_id"), F.col("c.root").alias("c_root"))
    rows = rows.join(small(centre, "centres"), "family")
    near = stored(rows.filter((F.col("g") + F.col("c_g") <= 0) & (F.col("doc_id") != F.col("c_id"))).select("family", "root", "c_root", F.col("c_id").alias("a"), F.col("doc_id").alias("b")), "near")
    merged = small(near.select("family", "root", F.col("c_root").alias("to")).distinct(), "merged-roots")
    rows = rows.join(merged, ["family", "root"], "left").withColumn("root", F.coalesce("to", "root")).select("family", "doc_id", "root", "n", "g", "d")
    still = small(rows.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("family"), "still-open")
    rows = stored(rows.join(still, "family"), "open-differences")
    key = ["family", "entry", "lo", "hi"]
    probes = stored(_probes(_shared_entries(rows), percent), "probes")
    live = probes.groupBy(*key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    live = live.filter((F.col("r0") < F.col("r1")) & (F.col("b0") == F.col("lo")) & (F.col("b1") == F.col("hi"))).select(*key)
    met = stored(probes.join(live, key), "met")
    x, y = (met.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "root", "bin", "n")]) for s in "xy")
    pairs = x.join(y, key).filter((F.col("bin_x") == F.col("lo")) & (F.col("bin_y") == F.col("hi")) & (F.col("root_x") != F.col("root_y")) & _may_fit(F.col("n_x"), F.col("n_y"), percent))
    pairs = pairs.select("family", F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).filter("a <> b").distinct()
    one, two = (rows.select(F.col("doc_id").alias(c), F.col("g").alias(f"g_{c}"), F.col("d").alias(f"d_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("d_a", "d_b"))
    linked = pairs.join(one, "a").join(two, "b").filter(2 * (100 + percent) * shared >= F.col("g_a") + F.col("g_b"))
    return near.select("a", "b").union(linked.select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id long, text): n_shingles, component_id and kept.

    A text's words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; its set holds the distinct windows of
    five words, or with fewer words the whole sequence. Texts are linked when 100 * intersection is at least
    percent * union; component_id is the smallest doc_id reachable over links, the own one included, and
    kept says that it is the own one. A null or wordless text has an empty set and no link. A row with a null
    doc_id takes no part in linking: its component is null and it is kept. Rows that repeat a doc_id are one
    node with the links of each of their texts, and give a row each. Other columns are ignored; an empty
    table gives no row.
    """
    m = collections_of(percent)
    feats = stored(features(docs, percent), "shingles")
    sets = feats.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = stored(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sub_keys").alias("sub_keys")), "classes")
    tables = stored(_table_keys(classes, m), "tables")
    star = stored(_star(tables), "star")
    release(tables)
    ids = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    texts = stored_rows_of(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), ids, "doc_id", "candidates")

    pairs = stored(compared(star, texts, percent), "compared")
    links = pairs.filter("linked").select("a", "b")
    members = _open_members(pairs, components(star), components(links))
    few = compared(_across(members.filter(F.col("size") <= SMALL_FAMILY), star, percent), texts, percent).filter("linked").select("a", "b")
    many = _in_large_families(members.filter(F.col("size") > SMALL_FAMILY), texts, percent)
    same_id = sets.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id")
    own = sets.join(same_id, "doc_id").join(classes.select("set_key", "rep"), "set_key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links.union(few).union(many).union(own))

    named = feats.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left")
    named = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns; rows with a null doc_id stay.

    Of rows that repeat a doc_id with equal text only one is left. The ids to drop are broadcast where they are at
    most SMALL_ROWS, else joined.
    """
    gone = small(near_duplicates(docs, percent).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    left = docs.join(gone, "doc_id", "left_anti")
    twice = stored(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = left.join(twice, "doc_id").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
