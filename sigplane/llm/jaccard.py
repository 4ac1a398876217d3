"""Similarity join of documents on word shingles by vertical partitioning.

All shingles have one global order: frequent ones last, else by hash.  Documents of equal sets become one
representative.  Two sets within the bound share a shingle in their prefixes of that order, and l shingles
in prefixes longer by l - 1; so a document none of whose keys, or less than l, occur elsewhere is done.  To
count an overlap the order is cut into fragments; each fragment of a pair is counted on its own, and the
partial counts are summed per pair.

Candidates are first drawn between each representative and a hub of each key, which joins most of a group
of near copies with as many pairs as it has members.  Then all pairs that share a key and are not yet
connected are looked at, so no link between components is lost.  The join itself leaves out what can't be
linked: each set has parity bits, one for each part of the hash space, that tell whether an odd number of its
shingles lies there.  Two sets differ in at least as many shingles as parity bits, and linked sets differ in
few; so of a large group of half-alike sets hardly a pair leaves the join.  A pair leaves it at its first common
key only.

All links of a document lie in its component, so they are counted there: the component's sets are dealt out in
blocks, and each two blocks are multiplied fragment by fragment, which gives all overlaps without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigplane.llm import storage

SHINGLE, PERCENT = 4, 85
FRAGMENTS = 4
#: Longs of parity bits of a set; more tell larger sets apart, fewer cost time only.
PARITY = 8
#: Shingles told as frequent: this only orders them, so the bound costs no link.
FREQUENT, IN_BATCH = 100_000, 8
#: Keys before a key that tell whether a pair has met before; further ones would only spare repeated pairs.
EARLIER = 64
#: Sets of a block, and columns multiplied at once, when links are counted.
BLOCK, AT_ONCE = 256, 8192
#: Keys of a representative that look for a hub; the last round uses all.
HUB_KEYS = 8
#: Bits of the bitmaps of shared keys and of documents to read again for each of them, and at most; a full one costs time only.
BITS_EACH, MOST_BITS = 8, 1 << 28
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words_each: int = SHINGLE) -> np.ndarray:
    """The set as sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    total = h[: len(h) - words_each + 1].copy()
    for i in range(1, words_each):
        total = total * _PRIME + h[i : len(h) - words_each + 1 + i]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _column(values: list[np.ndarray]) -> pa.Array:
    """Arrays of unsigned hashes as lists of signed numbers."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles, counted over all documents, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch["text"].to_pylist()]
            found, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            on = n >= IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(found[on].view(np.int64)), pa.array(n[on].astype(np.int64))], ["key", "n"])

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()["key"]
    return np.sort(top.to_numpy().view(np.uint64))


def _ordered(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Set elements in the global order."""
    late = np.isin(keys, frequent, assume_unique=True) if len(frequent) else np.zeros(len(keys), bool)
    return np.concatenate([keys[~late], keys[late]])


def _shared_least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """l: so many keys two sets within the bound share, the smaller of n elements, if prefixes allow for it."""
    return (n - -(-percent * n // 100) + 1) // 2 + 1


def _prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + _shared_least(n, percent) - 1) if n else 0


def _parity(keys: np.ndarray) -> bytes:
    """64 * PARITY bits: whether an odd number of the set lies in each part of the hash space."""
    part = keys * _PRIME >> np.uint64(64 - (64 * PARITY - 1).bit_length())
    return np.packbits(np.bincount(part.astype(np.int64), minlength=64 * PARITY) & 1).tobytes()


_BITS = [f"bits{i}" for i in range(PARITY)]


def _prefixes(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, hi, lo, prefix, bits...) of each row; hi and lo are 128 bits of the whole set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, prefixes, parity = [], [], [], []
            for t in batch["text"].to_pylist():
                s = shingles(t, k)
                sizes.append(len(s))
                names.append(blake2b(s.tobytes(), digest_size=16).digest())
                prefixes.append(_ordered(s, shared.value)[: _prefix_length(len(s), percent)])
                parity.append(_parity(s))
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            bits = np.frombuffer(b"".join(parity), np.int64).reshape(-1, PARITY)
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), _column(prefixes), *(pa.array(bits[:, i]) for i in range(PARITY))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "hi", "lo", "prefix", *_BITS])

    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, prefix array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the values modulo the size of the bitmap, a power of two that grows with them; merged by bitwise or."""
    values = storage.written(values.select(F.col(values.columns[0]).alias("key")), "bitmap-keys")
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * values.count()).bit_length()))
    cell = F.pmod(F.col("key"), F.lit(size))
    words = values.groupBy((cell / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def _candidates(sets: DataFrame, bitmap: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, n, hi, lo, keys, known, bits...): the shared prefix keys, in order, of documents that have enough of them.

    ``known`` is their share of the prefix in thousandths: in a group of near copies the one that the others
    were made from has the largest, as every other has shingles of its own.
    """
    shared = sets.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["prefix"]
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            row = np.repeat(np.arange(len(lists)), length)
            on = _in(shared.value, flat)
            flat, row = flat[on], row[on]
            counts = np.bincount(row, minlength=len(lists))
            n = batch["n"].to_numpy(zero_copy_only=False).astype(np.int64)
            # The partner may be smaller by the bound, and its l counts then.
            enough = counts >= _shared_least(-(-percent * n // 100), percent)
            keys = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
            out = batch.select(["doc_id", "n", "hi", "lo"]).append_column("keys", _column([k.view(np.uint64) for k in keys]))
            out = out.append_column("known", pa.array(1000 * counts // np.maximum(length, 1)))
            for b in _BITS:
                out = out.append_column(b, batch[b])
            yield out.filter(pa.array(enough))

    return sets.select("doc_id", "n", "hi", "lo", "prefix", *_BITS).mapInArrow(run, "doc_id long, n long, hi long, lo long, keys array<long>, known long, " + ", ".join(f"{b} long" for b in _BITS))


def _segments(docs: DataFrame, bitmap: np.ndarray, frequent: np.ndarray, k: int) -> DataFrame:
    """(doc_id, fragment, segment): the sets of documents in the bitmap, cut by the global order."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, late = shared.value
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            out: list[tuple[int, int, bytes]] = []
            for i in np.flatnonzero(_in(bits, ids)):
                s = shingles(batch["text"][i].as_py(), k)
                part = (s >> np.uint64(62)).astype(int)
                part[np.isin(s, late, assume_unique=True)] = FRAGMENTS  # frequent shingles are the order's last fragment
                out += [(int(ids[i]), int(f), s[part == f].tobytes()) for f in np.unique(part)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["doc_id", "fragment", "segment"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, fragment int, segment binary")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, overlap) of pairs (a, b): partial counts of each fragment, summed per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(n, pa.int64())], ["a", "b", "n"])

    left = pairs.join(segments.toDF("a", "fragment", "sa"), "a")
    both = left.join(segments.toDF("b", "fragment", "sb"), ["b", "fragment"])
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("overlap"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose similarity reaches the bound, as (a, b)."""
    counted = pairs.join(overlaps(pairs.select("a", "b"), segments), ["a", "b"])
    return counted.where(F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): the least id reachable over the edges (a, b), of every id in them.

    Each round takes the least label among the neighbours and then the label's label; labels are written
    between rounds, so a lost executor repeats one round at most.
    """
    both = storage.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = storage.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).toDF("rep", "comp"), "labels")
    while True:
        near = both.join(label.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "rep")
        step = label.join(near, "rep").select("rep", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.join(label.toDF("comp", "further"), "comp", "left").select("rep", "old", F.least("comp", "further").alias("comp"))
        new = storage.written(jump, "labels")
        changed = new.where("old <> comp").limit(1).count()
        label = new.select("rep", "comp")
        if not changed:
            return label


def _compatible(percent: int, x: str | Column = "na", y: str | Column = "nb") -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _differ(percent: int) -> Column:
    """The most shingles that are in one only of two linked sets of ``na`` and ``nb``."""
    both = F.col("na") + F.col("nb")
    return both - 2 * F.ceil(both * percent / (100 + percent))


def _hub_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): each representative and the hub that it meets most often."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    first = reps.select("rep", "n", "known", band.alias("band"), F.explode(F.slice("keys", 1, HUB_KEYS)).alias("key"))
    hubs = first.groupBy("key", "band").agg(F.max(F.struct("known", "rep", "n")).alias("hub"))
    wants = first.select("key", "rep", "n", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    met = wants.join(hubs, ["key", "band"]).where((F.col("hub.rep") != F.col("rep")) & _compatible(percent, F.col("n"), F.col("hub.n")))
    common = met.groupBy("rep", F.col("hub.rep").alias("hub")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("hub.n").alias("hn"))
    best = common.groupBy("rep").agg(F.max(F.struct("c", "hub", "n", "hn")).alias("x"))
    swap = F.col("rep") > F.col("x.hub")
    return best.select(
        F.least("rep", "x.hub").alias("a"), F.greatest("rep", "x.hub").alias("b"),
        F.when(swap, F.col("x.hn")).otherwise(F.col("x.n")).alias("na"), F.when(swap, F.col("x.n")).otherwise(F.col("x.hn")).alias("nb"),
    )


def _open_pairs(reps: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): all pairs of different components that share a key and whose parity bits allow a link."""
    keys = reps.select("rep", "n", F.explode("keys").alias("key")).join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    keys = storage.written(keys, "keys")
    met = keys.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("df")).where("c1 <> c2").select("key", "df")
    # Linked sets share l of these keys, so the first of them by frequency stays if each set leaves out its l - 1 most frequent.
    smaller = F.ceil(F.col("n") * percent / 100)
    spared = F.floor((smaller - F.ceil(smaller * percent / 100) + 1) / 2)
    lists = keys.join(met, "key").groupBy("rep").agg(F.first("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("by_df"))  # no longer than a document's prefix
    rare = lists.join(reps.select("rep", "n", *_BITS), "rep").where(F.size("by_df") > spared)
    rare = rare.withColumn("kept", F.slice("by_df", F.lit(1), F.greatest(F.size("by_df") - spared, F.lit(0)).cast("int"))["key"])
    rare = rare.select("rep", "n", "comp", *_BITS, "kept", F.posexplode("kept").alias("at", "key"))
    # All lists have one order, so a key is the first of a pair if no earlier one is common too.
    rare = rare.select("rep", "n", "comp", *_BITS, F.slice("kept", F.lit(1), F.least("at", F.lit(EARLIER))).alias("earlier"), "key")
    rare = storage.written(rare, "rare")
    left = rare.toDF("a", "na", "ca", *(f"l_{b}" for b in _BITS), "ea", "key")
    right = rare.toDF("b", "nb", "cb", *(f"r_{b}" for b in _BITS), "eb", "key")
    apart = sum((F.bit_count(F.col(f"l_{b}").bitwiseXOR(F.col(f"r_{b}"))) for b in _BITS), F.lit(0))
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _compatible(percent) & (apart <= _differ(percent)) & ~F.arrays_overlap("ea", "eb")
    return left.join(right, (left["key"] == right["key"]) & fits).select("a", "b", "na", "nb").distinct()


def _overlap_table(one: list[tuple[np.ndarray, np.ndarray]], two: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[int, int]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` and each of ``two``, given by fragment as (place, hash); partial counts are added."""
    total = np.zeros(sizes, np.float32)  # whole numbers, exact up to 2^24
    for (p, x), (q, y) in zip(one, two, strict=True):
        common = np.intersect1d(x, y)
        x_on, y_on = np.isin(x, common), np.isin(y, common)
        p, x, q, y = p[x_on], np.searchsorted(common, x[x_on]), q[y_on], np.searchsorted(common, y[y_on])
        for low in range(0, len(common), AT_ONCE):
            width = min(AT_ONCE, len(common) - low)
            a, b = np.zeros((sizes[0], width), np.float32), np.zeros((sizes[1], width), np.float32)
            i, j = (x >= low) & (x < low + width), (y >= low) & (y < low + width)
            a[p[i], x[i] - low] = 1
            b[q[j], y[j] - low] = 1
            total += a @ b.T
    return total


def link_counts(reps: DataFrame, label: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(rep, n_links): the number of all sets linked with each representative of a component of two or more.

    Blocks hold sets of like size, and blocks whose sizes allow for no link don't meet.  A component of two is one link.
    """
    at = F.row_number().over(Window.partitionBy("comp").orderBy("n", "rep")) - 1
    placed = label.join(reps.select("rep", "n"), "rep").withColumn("block", F.floor(at / BLOCK).cast("int")).withColumn("members", F.count("*").over(Window.partitionBy("comp")))
    placed = storage.written(placed, "placed")
    large = placed.where("members > 2")
    blocks = large.groupBy("comp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = blocks.toDF("comp", "x", "x_low", "x_high"), blocks.toDF("comp", "y", "y_low", "y_high")
    meet = one.join(two, "comp").where((F.col("x") <= F.col("y")) & (F.col("x_high") * 100 >= F.col("y_low") * percent)).select("comp", "x", "y")
    turns = meet.select("comp", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sets = segments.withColumnRenamed("doc_id", "rep").join(large.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("fragment", "segment")).alias("parts"))  # a row for each fragment
    dealt = large.join(sets, "rep").join(turns, ["comp", "block"]).select("comp", "x", "y", "block", "rep", "n", "parts")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        side = table["block"].to_numpy()
        ids, n, parts = table["rep"].to_numpy(), table["n"].to_numpy(), table["parts"].to_pylist()

        def of(block: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
            mine = np.flatnonzero(side == block)
            found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(FRAGMENTS + 1)]
            for place, row in enumerate(mine):
                for part in parts[row]:
                    found[part["fragment"]].append((place, np.frombuffer(part["segment"], np.uint64)))
            none = np.empty(0, np.uint64)
            return mine, [(np.repeat(np.array([i for i, _ in f], int), [len(s) for _, s in f]), np.concatenate([*(s for _, s in f), none])) for f in found]

        (a, one), (b, two) = of(x), of(y)
        overlap = _overlap_table(one, two, (len(a), len(b))).astype(np.int64)
        linked = 100 * overlap >= percent * (n[a][:, None] + n[b][None, :] - overlap)
        linked &= ids[a][:, None] != ids[b][None, :]
        counts = [linked.sum(1)] if x == y else [linked.sum(1), linked.sum(0)]
        return pa.table({"rep": pa.array(np.concatenate([ids[a], ids[b]][: len(counts)])), "c": pa.array(np.concatenate(counts).astype(np.int64))})

    counted = dealt.groupBy("comp", "x", "y").applyInArrow(run, "rep long, c long").groupBy("rep").agg(F.sum("c").alias("n_links"))
    pairs = placed.where("members = 2").select("rep", F.lit(1).cast("long").alias("n_links"))
    return pairs.unionByName(counted)


def join(docs: DataFrame, *, words_each: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id reachable by links; ``n_links`` counts all other sets that the
    document's set is linked with.  A text without words, or null, is linked
    with nothing.  Equal texts are linked.  Rows of one doc_id are one node.  A row
    with a null id has a null component.  An empty table gives no rows; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = _frequent(docs, words_each)
    sets = storage.written(_prefixes(docs, frequent, words_each, percent), "sets")
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = storage.written(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    shared = some.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    found = _candidates(some, _bitmap(shared), percent).join(classes, ["hi", "lo"], "left")
    reps = found.where("class_rep IS NULL OR class_rep = doc_id").dropDuplicates(["hi", "lo"]).withColumnRenamed("doc_id", "rep")
    reps = storage.written(reps.select("rep", "n", "known", "keys", *_BITS), "representatives")
    segments = storage.written(_segments(docs, _bitmap(reps.select("rep")), frequent, words_each), "segments")
    edges = storage.written(_links(storage.written(_hub_pairs(reps, percent).distinct(), "hub-pairs"), segments, percent), "hub-links")
    label = components(edges)
    rest = storage.written(_links(storage.written(_open_pairs(reps, label, percent), "open-pairs"), segments, percent), "open-links")
    edges = edges.unionByName(rest)
    if rest.limit(1).count():
        label = components(edges)
    degree = storage.written(link_counts(reps, label, segments, percent), "links")
    mine = sets.join(classes.select("hi", "lo", "class_rep"), ["hi", "lo"], "left")
    mine = mine.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("class_rep", "doc_id")).alias("rep"))
    out = mine.join(label, "rep", "left").join(degree, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a similarity of 0.85 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
