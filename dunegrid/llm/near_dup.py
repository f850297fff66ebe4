"""MinHash near-duplicates with tensored banding and exact verification.

Documents whose shingle sets have a Jaccard similarity of at least ``percent``
per cent are linked; groups are the links' connected components.

1. Documents with equal sets are one class; only classes go on.
2. Tensored banding: two collections of ``m`` hashes, each made of ``k``
   minwise hashes.  A table's key is a pair of one hash from each collection, so
   m * m tables need 2 * m * k minwise hashes instead of 2 * m * m * k.  A pair
   of similarity s misses every table with probability below
   2 * (1 - s**k)**m.  Hashes that no other class shares can be in no shared
   key and are left out before the pairs are formed.
3. Table buckets with the same members are one bucket (by a digest of their
   members).  Candidates are verified on whole sets, leaving out only pairs
   already known to be in one group.  First every class meets the smallest
   class of its buckets.  Then, in buckets that still hold several groups,
   one-permutation sketches (a byte per bin of the hash range) find the classes
   with a hopeful partner in another group; a pair counts in the first table it
   shares, and is ruled out only DEVIATIONS standard deviations below the
   threshold.  Those classes' whole sets are compared pair by pair inside the
   bucket, and only links that join two groups leave it (once for a few tables,
   so that a large group is one before all tables have their turn).  Both passes
   work on pairs of blocks of ``block`` rows, so a bucket of any size is many
   tasks; rows of its largest group go only to the blocks of the other groups,
   which are few then.  Where the other groups of a bucket still have more than
   ``block`` rows (texts that share a passage, say), its classes meet by an exact
   prefix filter over their whole sets instead.  No bucket is capped and no other
   pair between groups is skipped.
4. Components are found by large-star/small-star rounds.

Words, shingles and empty sets are those of ``shingles.shingle_set``; an empty
set is linked with nothing.  A NULL text has no words.  Of each group one
document is kept, that with the smallest doc_id (a NULL comes last), and of
several texts with that doc_id the one with the least digest; rows that share
doc_id and text are one document, so all of them are marked kept.  An empty table gives no rows.  Other columns are
not read by ``groups`` and are kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.llm import shingles
from dunegrid.llm.common import prepare, stored
from dunegrid.llm.components import components

#: Five standard deviations: a pair at the threshold is wrongly ruled out with
#: a probability of about 3e-7.
DEVIATIONS = 5
#: Tables whose buckets are joined before those of all tables.
FIRST_TABLES = 4


def hashes_needed(percent: int, k: int, miss: float = 1e-5) -> int:
    """Hashes per collection so that a pair at the threshold meets in one
    collection with probability 1 - miss."""
    s = (percent / 100) ** k
    return max(1, math.ceil(math.log(miss) / math.log(1 - s))) if s < 1 else 1


def text_key() -> Column:
    """What tells the texts of one doc_id apart (16 bytes; NULL is empty)."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def signatures(docs: DataFrame, words: int, m: int, k: int, seed: int = 1) -> DataFrame:
    """doc_id, key (of the text), n_shingles, class (128-bit set id), halves (2m hashes), signature."""
    schema = "doc_id long, key binary, n_shingles long, class binary, halves array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.MinHasher(2 * m * k, seed)
        for b in batches:
            n, ids, halves, sig = [], [], [], []
            for text in b.column("text"):
                s = shingles.shingle_set(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    ids.append(None), halves.append(None), sig.append(None)
                    continue
                ids.append(shingles.set_id(s))
                halves.append(shingles.combine(hasher(s).reshape(2 * m, k)))
                sig.append(shingles.sketch(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(halves, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "key", "n_shingles", "class", "halves", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInArrow(
        run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, n, members (array of shingle hashes) of the classes in ``wanted``
    (class, doc_id, key): the sets are made anew from the texts."""
    # a merge join at every size, so that what is shuffled follows the input
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", text_key().alias("_key")).join(
        wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))).select(
            "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids, sets = [], []
                for c, text in zip(part.column("class"), part.column("text")):
                    s = shingles.shingle_set(text.as_py(), words)
                    if shingles.set_id(s) == c.as_py():
                        ids.append(c.as_py()), sets.append(s.view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                         pa.array(sets, pa.list_(pa.int64()))], names=["class", "n", "members"])

    return rows.mapInArrow(run, "class binary, n long, members array<long>").dropDuplicates(["class"])


def buckets(classes: DataFrame, m: int, n: int) -> DataFrame:
    """bucket, table, class, rows (of the bucket), least (its smallest class):
    distinct tables' buckets of two or more of the ``n`` classes."""
    halves = classes.select("class", F.posexplode("halves").alias("pos", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    one = F.struct("pos", "half")
    live = halves.join(shared, "half").groupBy("class").agg(  # at most m of each kind
        F.collect_list(F.when(F.col("pos") < m, one)).alias("first"),
        F.collect_list(F.when(F.col("pos") >= m, one)).alias("second"))
    live = stored(live, "shared-hashes", n)
    keys = live.select("class", F.explode("first").alias("x"), "second").select(
        "class", F.explode("second").alias("y"), "x").select(
            "class", F.xxhash64("x.half", "y.half").alias("bucket"),
            (F.col("x.pos") * m + F.col("y.pos") - m).alias("table"))
    members = (keys.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.min("class").alias("least"), F.min("table").alias("table"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.sum(F.xxhash64("class", F.lit(1)).cast("decimal(20,0)")).alias("s")).filter("rows > 1"))
    # of buckets with the same members the one of the first table stays
    distinct = members.groupBy("rows", "least", "x", "s").agg(F.min(F.struct("table", "bucket")).alias("t"))
    return keys.select("class", "bucket").join(
        distinct.select("t.bucket", "t.table", "rows", "least"), "bucket")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several groups, with the bucket's largest
    group (``main``), its rows (``most``) and the rows of all others (``others``)."""
    sizes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"),
        (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    return rows.join(shape, "bucket")


def _split(rows: DataFrame, block: int) -> DataFrame:
    """Deal the rows of ``shaped`` buckets to pairs of blocks of about ``block``
    rows: (bucket, low, high) is a group, ``side`` the row's own block.  Rows of
    the largest group are not paired with each other, so they go to the blocks
    of the other groups only."""
    blocks = F.ceil(F.col("others") / F.lit(float(block))).cast("int")
    main_blocks = F.ceil(F.col("most") / F.lit(float(block))).cast("int")
    is_main, number = F.col("root") == F.col("main"), F.xxhash64("class")
    side = F.when(is_main, blocks + F.pmod(number, main_blocks)).otherwise(F.pmod(number, blocks)).cast("int")
    others = F.when(is_main, F.sequence(F.lit(0), blocks - 1)).otherwise(F.sequence(F.lit(0), blocks + main_blocks - 1))
    rows = rows.withColumn("side", side).withColumn("other", F.explode(others)).drop("main", "most", "others")
    return rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))


#: Shingles of a prefix join that are told to be common (with their counts).
COMMON = 50_000


def prefix_buckets(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, table (-1), class, root: a bucket per shingle, holding the classes
    that have it among their first ``n - ceil(n * percent / 100) + 1`` shingles,
    rare ones first.  Two sets that reach the threshold share such a shingle,
    whatever the order (exact prefix filter)."""
    members = classes.join(sets, "class").select("class", "root", "n", F.explode("members").alias("bucket"))
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    total = classes.join(sets.select("class", "n"), "class").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.broadcast(counts.filter(F.col("c") * COMMON > total))  # fewer than COMMON rows
    ordered = members.join(common, "bucket", "left").groupBy("class", "root", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "bucket"))).alias("s"))
    most = F.expr(f"CAST(n - (n * {percent} + 99) DIV 100 + 1 AS INT)")
    return ordered.select("class", "root", F.explode(F.slice("s", F.lit(1), most)).alias("x")).select(
        "x.bucket", F.lit(-1).alias("table"), "class", "root")


def _pairs_of(t: pa.Table, root: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different groups of a pair of blocks, about ``most`` at a time."""
    n = t.num_rows
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    side, number = t.column("side").to_numpy(), np.arange(n)
    step = max(1, most // max(1, n))
    for lo in range(0, n, step):
        rows = slice(lo, min(n, lo + step))
        apart = root[rows, None] != root[None, :]
        if low == high:
            apart &= number[rows, None] < number[None, :]
        else:
            apart &= (side[rows, None] == low) & (side[None, :] == high)
        i, j = np.nonzero(apart)
        if len(i):
            yield i + lo, j


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    """Equal values of a binary column as equal numbers."""
    return np.unique(np.array(t.column(column).to_pylist(), dtype=object), return_inverse=True)[1]


def hopeful(m: int, percent: int):
    """The classes of a pair of blocks that have a partner in another group
    which their sizes and sketches do not rule out and which no earlier table
    puts next to them."""
    def run(t: pa.Table) -> pa.Table:
        n, root, size = t.num_rows, _numbers(t, "root"), t.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(n, -1)
        halves = t.column("halves").combine_chunks().flatten().to_numpy().reshape(n, -1)
        table = t.column("table")[0].as_py()
        x, y = divmod(table, m) if table >= 0 else (0, 0)  # a prefix bucket is of no table
        p = percent / 100
        hit = np.zeros(n, bool)
        for i, j in _pairs_of(t, root, 1 << 15):
            ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            for first, last in ((0, x), (m, m + y)):
                i, j = i[ok], j[ok]
                ok = ~(halves[i, first:last] == halves[j, first:last]).any(axis=1)
            i, j = i[ok], j[ok]
            a, b = sketch[i], sketch[j]
            bins = np.maximum(1, ((a | b) > 0).sum(axis=1))
            share = ((a == b) & (b > 0)).sum(axis=1) / bins
            # the bins sample the union (of this size at the threshold) without repeats
            union = (size[i] + size[j]) / (1 + p)
            left_out = np.sqrt(np.maximum(0.1, 1 - bins / union))
            ok = share >= p - DEVIATIONS * left_out * np.sqrt(p * (1 - p) / bins)
            hit[i[ok]] = hit[j[ok]] = True
        return t.select(["bucket", "class", "root"]).filter(pa.array(hit))
    return run


def exact_links(percent: int):
    """Links (a, b) between the groups of a pair of blocks, as few as join what
    whole sets join: one set is marked at a time and met with all others at once."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        ids = t.column("root").to_pylist()
        members = t.column("members").combine_chunks()
        at = members.offsets.to_numpy() - members.offsets[0].as_py()
        shingle = np.unique(members.flatten().to_numpy(), return_inverse=True)[1]
        size, mark = np.diff(at), np.zeros(len(shingle), bool)
        group = _numbers(t, "root")
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        side, number, found = t.column("side").to_numpy(), np.arange(len(ids)), []
        for i in range(len(ids)):
            others = group != group[i]
            others &= (number > i) if low == high else (side == high)
            if (low != high and side[i] != low) or not others.any():
                continue
            own = shingle[at[i]:at[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[shingle], at[:-1], dtype=np.int64)
            mark[own] = False
            for j in np.flatnonzero(others & (100 * both >= percent * (size + size[i] - both))):
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()),
                         "b": pa.array([y for _, y in found], pa.binary())})
    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int, per_copy: int = 64) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    a = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("members").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("members").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    # a class with many partners stands once per ``per_copy`` of them
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(per_copy))).cast("int").alias("copies"))
    a = a.join(copies, "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    pairs = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int")).drop("copies")
    return (pairs.join(a, ["a", "copy"]).join(b, "b").filter(100 * small >= percent * large)
            .withColumn("both", both).filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b"))


def linked(docs: DataFrame, rows: DataFrame, percent: int, words: int, m: int, block: int) -> DataFrame:
    """(class, root) of the classes that are linked with another one."""
    # rows of one class have the same hashes, so any row's will do
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"),
        F.any_value("halves").alias("halves"), F.any_value("n_shingles").alias("n"),
        F.any_value("signature").alias("signature"))
    classes = stored(classes.select("class", "first.doc_id", "first.key", "halves", "n", "signature"), "classes", rows.count())
    total = classes.count()
    found = stored(buckets(classes, m, total), "buckets", total)
    wanted = found.select("class").distinct().join(classes.select("class", "doc_id", "key"), "class")
    wanted = stored(wanted, "wanted", total)
    sets = stored(whole_sets(docs, wanted, words), "whole-sets", wanted.count(), 5_000)

    # 1. every class with the smallest class of its buckets
    pairs = found.groupBy("class").agg(F.min("least").alias("least")).filter("class != least")
    links = stored(verify(pairs.select(F.col("least").alias("a"), F.col("class").alias("b")), sets, percent),
                   "links-to-least", total)
    roots = components(links).select(F.col("node").alias("class"), "root")

    def join_buckets(first: int = 0) -> None:
        """Merge groups that share a link inside a bucket (of the ``first`` tables)."""
        nonlocal roots
        at = found.filter(F.col("table").isin([i * m + i for i in range(min(first, m))])) if first else found
        at = at.join(roots.withColumnRenamed("root", "_root"), "class", "left").withColumn(
            "root", F.coalesce("_root", "class")).drop("_root")
        at = shaped(at.select("bucket", "table", "class", "root"))
        if not first:  # of what the first tables left apart
            at = stored(at, "split-buckets", total)
            wide = at.filter(F.col("others") > block).select("class", "root").distinct()
            if not wide.isEmpty():
                wide = stored(prefix_buckets(wide, sets, percent), "prefix-buckets", total)
                at = at.filter(F.col("others") <= block).unionByName(shaped(wide))
        # who may have a partner in another group?
        at = at.join(classes.drop("doc_id", "key"), "class")
        hope = _split(at, block).groupBy("bucket", "low", "high").applyInArrow(
            hopeful(m, percent), "bucket long, class binary, root binary")
        hope = stored(hope.distinct(), "hopeful", total)
        # whole sets of those, bucket by bucket
        whole = shaped(hope).join(sets.select("class", "members"), "class")
        more = _split(whole, max(1, block // 2)).groupBy("bucket", "low", "high").applyInArrow(
            exact_links(percent), "a binary, b binary")
        more = stored(more.distinct(), "links-between", total)
        if more.isEmpty():
            return
        merged = components(more)
        old = roots.join(merged, roots["root"] == merged["node"], "left").select(
            "class", F.coalesce(merged["root"], roots["root"]).alias("root"))
        new = merged.join(roots.select("class"), merged["node"] == F.col("class"), "left_anti").select(
            F.col("node").alias("class"), "root")
        roots = stored(old.unionByName(new), "groups", total)

    # 2. buckets of a few tables, which join most of a large group, then of all
    join_buckets(FIRST_TABLES)
    join_buckets()
    return roots


def groups(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, key, n_shingles, class, component_id, kept for every row."""
    prepare(docs.sparkSession)
    m = hashes_needed(percent, k)
    n = docs.count()
    rows = stored(signatures(docs, words, m, k), "signatures", n, 5_000)
    roots = linked(docs, rows, percent, words, m, block)
    small = rows.select("doc_id", "key", "n_shingles", "class")
    at = small.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = at.filter("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    at = at.join(least.select("root", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("_key")),
                 "root", "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("key").eqNullSafe(F.col("_key")))
    return at.select("doc_id", "key", "n_shingles", "class", component.alias("component_id"),
                     kept.alias("kept")).coalesce(max(1, -(-n // 25_000)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """Rows of ``docs``, one of each group: that with the smallest doc_id.

    Rows that share both doc_id and text count as one row; a document without
    words is in no group and stays.
    """
    kept = groups(docs, words, percent, **options).filter("kept").select(
        F.col("doc_id").alias("_kept"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       text_key().alias("_text"))
    both = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_key")), "left_semi")
    return both.dropDuplicates(["_id", "_text"]).select("row.*")
