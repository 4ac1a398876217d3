"""Order MinHash fingerprints: signatures that follow edit distance, not only shared parts.

The k-mers are runs of words, numbered by occurrence so that repeats count.  Each entry of a signature
selects minimal k-mers, one by each of its hash functions, puts them in the order of the text and hashes
the tuple.  A hash function and the place in the text share one 64-bit number (40 bits hash, 24 bits
place), so the selection is a plain minimum, aggregated within each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigplane.llm import storage

K = 2
ENTRIES = 32
PER_TUPLE = 2
#: Ids per bucket of neighbouring documents.
RADIX = 256
_PLACE = (1 << 24) - 1
_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _constants(n: int) -> list[int]:
    """Signed 64-bit numbers of a fixed generator, one per hash function."""
    out = []
    for i in range(1, n + 1):
        z = i * _MIX & _MASK
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        z ^= z >> 31
        out.append((z & ~_PLACE) - (1 << 64 if z >> 63 else 0))
    return out


def _kmers(text: Column, k: int) -> Column:
    """Hashes of the runs of k words in order; a text of fewer words is one run, one without words none."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(
            F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        )

    # Through an array of one, so that the words are hashed once.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def signatures(texts: DataFrame, key: list[str], *, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """``key`` and ``signature`` (array<bigint>, empty for a text without words) of ``texts`` (key, text).

    If ``texts`` is dealt by a part of ``key``, nothing is shuffled.
    """
    constants = _constants(entries * PER_TUPLE)
    # Sorted within the row, the rows of a text arrive in the order the window wants.
    kmers = texts.select(*key, F.posexplode_outer(_kmers(F.col("text"), k)).alias("place", "kmer"))
    number = F.row_number().over(Window.partitionBy(*key, "kmer").orderBy("place"))
    base = kmers.select(*key, F.least("place", F.lit(_PLACE)).cast("long").alias("place"), F.when(F.col("kmer").isNotNull(), F.xxhash64("kmer", number).bitwiseAND(F.lit(~_PLACE))).alias("x"))
    least = base.groupBy(*key).agg(*(F.min(F.col("x").bitwiseXOR(F.lit(c)).bitwiseOR(F.col("place"))).alias(f"m{i}") for i, c in enumerate(constants)))

    def entry(i: int) -> Column:
        picked = [F.struct(F.col(f"m{j}").bitwiseAND(F.lit(_PLACE)).alias("p"), F.col(f"m{j}").bitwiseXOR(F.lit(constants[j])).bitwiseAND(F.lit(~_PLACE)).alias("x")) for j in range(i * PER_TUPLE, (i + 1) * PER_TUPLE)]
        first, second = picked
        swap = first["p"] > second["p"]
        return F.xxhash64(F.when(swap, second["x"]).otherwise(first["x"]), F.when(swap, first["x"]).otherwise(second["x"]))

    return least.select(*key, F.when(F.col("m0").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(*(entry(i) for i in range(entries)))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; 1 for two texts without words, 0 if one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(same / F.greatest(F.size(a), F.size(b)), F.lit(0.0)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _following(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id): for each bucket of ids, the id that follows its lowest in descending order.

    Levels of buckets, each ``RADIX`` times wider, until one holds all; so no task sees more than
    ``RADIX`` keys of a level.
    """
    spark = docs.sparkSession
    level = docs.groupBy(F.floor(F.col("doc_id") / RADIX).alias("bucket")).agg(F.max("doc_id").alias("head"))
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends["a"] is None:
        return spark.createDataFrame([], "bucket long, doc_id long")

    def link(level: DataFrame, low: int, high: int) -> DataFrame:
        """(bucket, next_head): the head of the next lower bucket; the lowest has the highest head."""
        if low == high:
            return level.select("bucket", F.lit(ends["b"]).alias("next_head"))
        level = level.withColumn("up", F.floor(F.col("bucket") / RADIX))
        inner = level.withColumn("next_head", F.lead("head").over(Window.partitionBy("up").orderBy(F.desc("bucket"))))
        above = level.groupBy("up").agg(F.max("head").alias("head")).withColumnRenamed("up", "bucket")
        over = link(above, low // RADIX, high // RADIX).toDF("up", "up_head")
        return inner.join(over, "up").select("bucket", F.coalesce("next_head", "up_head").alias("next_head"))

    return storage.written(link(level, ends["a"] // RADIX, ends["b"] // RADIX), "following").toDF("bucket", "doc_id")


def fingerprint(docs: DataFrame, *, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document in descending doc_id, the first after the last.  A null text counts as empty; without words
    the fingerprint is empty.  Rows of one id are ordered by their text, equal rows give equal rows.  A
    null id comes last and its text isn't read by others.  Very long texts are read whole: beyond 16
    million words places in the text count as equal.  An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.floor(F.col("doc_id") / RADIX)
    # The document after a bucket's last is brought to it as a guest.
    guests = rows.join(_following(rows.where("doc_id IS NOT NULL").select("doc_id")).toDF("bucket", "guest_id"), F.col("doc_id") == F.col("guest_id"))
    every = rows.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests.select("bucket", F.lit(True).alias("guest"), "doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), "text")
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    linked = every.select("*", F.row_number().over(order).alias("row"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text")).withColumn("edited", edited)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    both = linked.select("bucket", "row", "guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), sides.alias("x"))
    both = both.where("NOT guest OR x.side = 0").select("bucket", "row", "guest", "doc_id", "n_chars", F.when(F.col("x.side") == 1, F.col("sha")).alias("sha"), "x.side", "x.text")
    found = signatures(both, ["bucket", "row", "guest", "doc_id", "n_chars", "sha", "side"], k=k, entries=entries)
    one = found.groupBy("bucket", "row").agg(
        F.first("guest").alias("guest"), F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("side") == 0, F.col("signature"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("signature"))).alias("b"),
    )
    following = F.coalesce(F.lead("a").over(Window.partitionBy("bucket").orderBy("row")), F.array().cast("array<bigint>"))
    return one.withColumn("c", following).where("NOT guest").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
