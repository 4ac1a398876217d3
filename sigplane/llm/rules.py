"""Quality rules whose limits adapt to each language and source.

Every document gets counts from built-in functions.  For each (language, source) each measure is summarised
in a quantile sketch: counts of bins whose width is a 64th of their value at most, so that every quantile has
that relative error.  Sketches merge by addition: they are pre-aggregated on the map side, hold some thousand
bins at most, and those of a language's sources add up to the language's, which small sources use.  A limit
is the upper decile plus a multiple of its distance to the median; for the length of words there is a lower one
too.  The limits are joined back and the documents beyond one are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigplane.llm import storage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Ratios are counted in millionths.
UNIT = 1_000_000
#: Bins of each power of two.
STEPS = 64
#: Groups of fewer documents take the limits of their language.
MIN_GROUP = 30
#: measure: (numerator, denominator, multiple of the distance between decile and median, least distance of a limit from the median, whether there is a lower limit)
RATIOS = {
    "symbols": ("n_symbols", "n_words", 6, 50_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 6, 200_000, False),
    "repeats": ("n_repeat_words", "n_words", 6, 40_000, False),
    "length": ("word_chars", "n_words", 6, 500_000, True),
}


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counts of each text, by arrays within the row: no shuffle, no explosion.

    A 3-word window is told by the 64-bit hash of its words: within one text of 20,000 words a clash has
    a chance of 1e-11.  Texts whose windows all differ, the most, need no sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    step = base.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("g"),
    )
    has_repeats = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.when(has_repeats, F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*keep, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), placed.alias("s"))

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get("s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", i + 1)["h"], F.lit(False))

    step = step.withColumn("r", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("r", lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("r", i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _value(numerator: str, denominator: str) -> Column:
    return F.floor(F.lit(UNIT) * F.col(numerator) / F.greatest(F.col(denominator), F.lit(1))).cast("long")


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def bin_of(v: Column) -> Column:
    """The bin of a number: itself below ``STEPS``, else its power of two and the bits after the first."""
    power = F.greatest(F.length(F.bin(v)) - STEPS.bit_length(), F.lit(0))
    return (power * STEPS + _shift("shiftright", v, power)).cast("long")


def bin_value(b: Column) -> Column:
    """The least number of a bin."""
    power = F.greatest(F.floor(b / STEPS) - 1, F.lit(0))
    return _shift("shiftleft", b - STEPS * power, power).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the documents that pass the base rule."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("measure"), bin_of(_value(a, b)).alias("bin")) for r, (a, b, *_) in RATIOS.items())))
    return counts.where(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """The sum of the sketches of each group."""
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def deciles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, measure, total, q1, q5, q9): the lower decile, the median and the upper decile."""
    group = Window.partitionBy(*by, "measure")  # the bins of a sketch, not documents
    run = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    cut = lambda k: bin_value(F.min(F.when(F.col("upto") * 10 >= F.col("total") * k, F.col("bin")))).alias(f"q{k}")
    return run.groupBy(*by, "measure").agg(F.max("total").alias("total"), cut(1), cut(5), cut(9))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, and least_ and most_ of each measure) from the sketches."""
    own = deciles(sketch, "lang", "source")
    whole = deciles(merged(sketch, "lang"), "lang").toDF("l", "m", "t", "w1", "w5", "w9")
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    q1, q5, q9 = (F.when(F.col("total") >= MIN_GROUP, F.col(f"q{k}")).otherwise(F.col(f"w{k}")) for k in (1, 5, 9))
    found = []
    for r, (_, _, multiple, least, lower) in RATIOS.items():
        here = F.col("measure") == r
        found.append(F.max(F.when(here, q5 + F.greatest(q9 - q5 + multiple * (q9 - q5), F.lit(least)))).alias(f"most_{r}"))
        if lower:
            found.append(F.max(F.when(here, q5 - F.greatest(q5 - q1 + multiple * (q5 - q1), F.lit(least)))).alias(f"least_{r}"))
    return both.groupBy("lang", "source").agg(*found)


def judge(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """Counts, base_failed and kept of each row of ``docs`` (doc_id, text, lang, source).

    A null text counts as empty and fails the base rule.  A null language or source is a group of its
    own.  Repeated rows are judged each.  An empty table gives no rows.  Extra columns are ignored.
    """
    keep = ["doc_id", "lang", "source"]
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = storage.written(features(docs, keep).withColumn("base_failed", failed), "rules")
    bound = limits(sketches(counts)).withColumnsRenamed({"lang": "l", "source": "s"})
    joined = counts.join(bound, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    beyond = F.lit(False)
    for r, (a, b, _, _, lower) in RATIOS.items():
        beyond = beyond | F.coalesce(_value(a, b) > F.col(f"most_{r}"), F.lit(False))
        if lower:
            beyond = beyond | F.coalesce(_value(a, b) < F.col(f"least_{r}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(coalesce(least(3, i - p), 3)) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000000 * n_symbols // greatest(n_words, 1) AS v1, 1000000 * n_dup_lines // greatest(n_lines, 1) AS v2,
             1000000 * n_repeat_words // greatest(n_words, 1) AS v3, 1000000 * word_chars // greatest(n_words, 1) AS v4 FROM c),
v AS (SELECT lang, source, m, v, greatest(length(bin(v)) - 7, 0) AS p
      FROM (SELECT lang, source, unnest([1, 2, 3, 4]) AS m, unnest([v1, v2, v3, v4]) AS v FROM f WHERE NOT base_failed)),
s AS (SELECT lang, source, m, p * 64 + (v >> CAST(p AS INTEGER)) AS b, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, m) AS total FROM s),
ws AS (SELECT lang, m, b, sum(n) AS n FROM s GROUP BY ALL),
wo AS (SELECT *, sum(n) OVER (PARTITION BY lang, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, m) AS total FROM ws),
d AS (SELECT lang, source, m, max(total) AS total, min(b) FILTER (upto * 10 >= total) AS b1, min(b) FILTER (upto * 10 >= total * 5) AS b5, min(b) FILTER (upto * 10 >= total * 9) AS b9 FROM o GROUP BY lang, source, m),
wd AS (SELECT lang, m, min(b) FILTER (upto * 10 >= total) AS w1, min(b) FILTER (upto * 10 >= total * 5) AS w5, min(b) FILTER (upto * 10 >= total * 9) AS w9 FROM wo GROUP BY lang, m),
e AS (SELECT d.lang, source, d.m, CASE WHEN total >= 30 THEN b1 ELSE w1 END AS b1, CASE WHEN total >= 30 THEN b5 ELSE w5 END AS b5, CASE WHEN total >= 30 THEN b9 ELSE w9 END AS b9
      FROM d JOIN wd ON d.lang IS NOT DISTINCT FROM wd.lang AND d.m = wd.m),
h AS (SELECT lang, source, m, (b1 - 64 * greatest(b1 // 64 - 1, 0)) << CAST(greatest(b1 // 64 - 1, 0) AS INTEGER) AS q1,
             (b5 - 64 * greatest(b5 // 64 - 1, 0)) << CAST(greatest(b5 // 64 - 1, 0) AS INTEGER) AS q5,
             (b9 - 64 * greatest(b9 // 64 - 1, 0)) << CAST(greatest(b9 // 64 - 1, 0) AS INTEGER) AS q9 FROM e),
q AS (SELECT lang, source, max(q5 + greatest(7 * (q9 - q5), 50000)) FILTER (m = 1) AS m1, max(q5 + greatest(7 * (q9 - q5), 200000)) FILTER (m = 2) AS m2,
             max(q5 + greatest(7 * (q9 - q5), 40000)) FILTER (m = 3) AS m3, max(q5 + greatest(7 * (q9 - q5), 500000)) FILTER (m = 4) AS m4,
             max(q5 - greatest(7 * (q5 - q1), 500000)) FILTER (m = 4) AS l4 FROM h GROUP BY lang, source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(v1 > m1 OR v2 > m2 OR v3 > m3 OR v4 > m4 OR v4 < l4, false) AS kept
FROM f LEFT JOIN q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source
"""
