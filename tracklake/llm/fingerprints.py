"""Operator 9: document fingerprints as bottom-k sketches of shingle hashes, in DataFrame and SQL functions only.

A sketch holds the k least hashes of a text's five-word shingles, ascending. Sketches of parts merge into that of the
whole, and tell resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import table

WORDS = 5
K = 128
#: Documents in a range of ids, about. Beyond FIRST ranges each is cut again, into as many at most: FIRST bounds reach the
#: driver, FIRST**2 the tasks.
RANGE_ROWS = 4096
FIRST = 1024
WHITE = " \t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    """The hashes of the words between ASCII white space."""
    trimmed = F.trim(text, F.lit(WHITE))
    return F.transform(F.filter(F.split(trimmed, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, words: int = WORDS) -> Column:
    """The hashes of all runs of ``words`` words; fewer words than that are one run, none give none."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]))
    return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """The rows of ``df`` with the sketch of column ``text``; null counts as empty, which has an empty sketch.

    The words' hashes are a projection of their own, so that each word is hashed once.
    """
    hashed = df.withColumn(f"{name}_words", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    least = F.slice(F.sort_array(F.array_distinct(shingle_hashes(f"{name}_words", words))), 1, k)
    return hashed.withColumn(name, least).drop(f"{name}_words")


def merge_sketches(sketches: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: that of all its parts' shingles together."""
    least = sketches.select(*by, F.explode(sketch).alias("h")).distinct()
    top = least.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact where the union has at most k shingles. Two empty sketches are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(common / F.least(F.size(F.array_union(a, b)), F.lit(k)))


def distinct_shingles(sketch: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null for an empty a."""
    j = resemblance(a, b, k)
    return F.least(F.lit(1.0), j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + j) / F.nullif(distinct_shingles(a, k), F.lit(0.0)))


def as_string(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every row's doc_id, text and sketch. A null text counts as empty and has an empty sketch; equal texts have equal
    sketches, repeated rows stay, an empty table gives an empty result, and other columns are not read."""
    return with_sketch(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), "text", "sketch", k)


def below(cuts: Column, value: Column) -> Column:
    """How many of the ascending ``cuts``, fewer than FIRST, are less than the value, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((FIRST - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def quantiles(order: str, parts: int) -> Column:
    """The bounds between so many parts of about as many rows; ascending, each once."""
    return F.array_sort(F.array_distinct(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * FIRST)))


def with_ranges(rows: DataFrame, order: str) -> DataFrame:
    """The rows with range_, ascending with ``order`` in ranges of about RANGE_ROWS rows."""
    n = rows.count()
    first = max(1, min(FIRST, n // RANGE_ROWS))
    if first == 1:
        return rows.withColumn("range_", F.lit(0).cast("bigint"))
    cuts = rows.agg(quantiles(order, first)).first()[0]
    rows = rows.withColumn("range_", below(F.array(*[F.lit(c) for c in cuts]), F.col(order)).cast("bigint"))
    second = min(FIRST, n // first // RANGE_ROWS)
    if second < 2:
        return rows
    inner = rows.groupBy("range_").agg(quantiles(order, second).alias("cuts_"))
    return rows.join(F.broadcast(inner), "range_").withColumn("range_", F.col("range_") * FIRST + below(F.col("cuts_"), F.col(order))).drop("cuts_")


def with_next(rows: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """The rows with next_<column> of the next row by descending ``key`` (nulls last), then ``tie``; the first follows the last.

    The key is an integer. Rows are dealt into ranges of it, whose number grows with the table. The first row of each
    range is also put behind the range before it, so each range is finished alone. What is broadcast are a bound and a
    neighbour for each range, FIRST**2 at most. A key is held to be (nearly) unique. Repeated rows follow each other.
    """
    if not isinstance(rows.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer, not {rows.schema[key].dataType.simpleString()}")
    rows = with_ranges(rows.withColumn("order_", F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))), "order_")
    tops = rows.groupBy("range_").agg(F.max("order_").alias("top_"))
    following = Window.orderBy("range_")
    tops = tops.withColumns({"before_": F.lead("range_").over(following), "least_": F.min("range_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    tops = tops.select("range_", "top_", F.coalesce("before_", "least_").alias("before_"))
    rows = rows.join(F.broadcast(tops), "range_")
    here = F.struct(F.col("range_").alias("at"), F.lit(False).alias("extra"))
    behind = F.when(F.col("order_") == F.col("top_"), F.array(here, F.struct(F.col("before_").alias("at"), F.lit(True).alias("extra")))).otherwise(F.array(here))
    rows = rows.withColumn("to_", F.explode(behind))
    rows = rows.select("*", F.col("to_.at").alias("at_"), F.col("to_.extra").alias("extra_"))
    window = Window.partitionBy("at_").orderBy("extra_", F.desc("order_"), tie)
    rows = rows.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    return rows.filter(~F.col("extra_")).drop("order_", "range_", "top_", "before_", "to_", "at_", "extra_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(table(spark, sf_dir, "documents")), "doc_id", "text", ["text", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("sketch").alias("fingerprint"), as_string("edited_sketch").alias("edited_fingerprint"), resemblance("sketch", "edited_sketch").alias("near_edited"), resemblance("sketch", "next_sketch").alias("near_next"), containment("edited_sketch", "sketch").alias("edited_in_text"), distinct_shingles("sketch").alias("n_shingles"))
