"""Operator 10: line dedup over content-defined chunks of lines, in DataFrame and SQL functions only.

A rolling hash over the hashes of neighbouring lines says where a chunk ends: where it is least among its neighbours. So
the cuts inside a passage do not depend on what stands before it, and no chunk of short lines is a lone line. A line of so
many words that it is a passage is a chunk by itself. Chunks that occur again anywhere are removed but for their first
occurrence. Grouping by the chunks' bytes makes the comparison; hashes only carry its outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import cut, table

#: Weight of the line before in the rolling hash over two lines.
WEIGHT = 7
#: A line of more words is a passage, and a chunk by itself.
PASSAGE_WORDS = 50
#: A document of which so many hundredths of the words are repeats is a copy: the stage drops what is left of it.
COPY_PERCENT = 75


def line_value(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("bigint")


def is_passage(line: Column) -> Column:
    """Whether a line has more than PASSAGE_WORDS words; shorter ones than those need are not searched."""
    return F.when(F.length(line) > 2 * PASSAGE_WORDS, n_words(line) > PASSAGE_WORDS).otherwise(False)


def with_spans(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which has ``lines``, with spans: chunks as (first line from 1, number of lines, whether it is a
    passage), in order.

    Each step is a projection of its own, so that no line is hashed more than once.
    """
    df = df.withColumn("told", F.transform("lines", lambda x: F.struct(line_value(x).alias("v"), is_passage(x).alias("long"))))
    df = df.withColumn("rolled", F.transform("told", lambda t, i: t.v + F.lit(WEIGHT) * F.coalesce(F.get("told", i - 1).v, F.lit(0))))
    last = F.size("lines") - 1
    long = lambda i: F.get("told", i).long
    r = lambda i: F.get("rolled", i)
    # Two lines before the cut and two after it, all short: a null says that there is no such line.
    inside = lambda i: ~long(i - 1) & ~long(i + 1) & ~long(i + 2) & (r(i) < r(i - 1)) & (r(i) <= r(i + 1))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | long(i) | F.coalesce(long(i + 1), F.lit(False)) | F.coalesce(inside(i), F.lit(False)))
    df = df.withColumn("ends", F.when(F.size("lines") > 0, ends).otherwise(F.array()))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("ends")), F.lit(1), F.size("ends"))
    return df.withColumn("spans", F.zip_with("ends", before, lambda e, b: F.struct((b + 2).alias("at"), (e - b).alias("n"), long(e).alias("long")))).drop("told", "rolled", "ends")


def chunked(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with id, key (of the row's text), lines and spans; a null text counts as empty."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return with_spans(df.select(F.col(f"`{doc_id}`").alias("id"), F.md5(body).alias("key"), F.split(body, "\n").alias("lines")))


def occurrences(rows: DataFrame, as_hash: bool = False) -> DataFrame:
    """A row for each chunk of several lines, or passage, that is not blank: id, key, place in the document, the chunk or its hash.

    The chunks are made before they are dealt out, so that no row carries all lines of its document; and dealt out by the
    outer form, for which Spark adds no filter on the document that would compute the chunks again.
    """

    def told(span: Column) -> Column:
        chunk = F.array_join(F.slice("lines", span.at, span.n), "\n")
        return F.struct((F.md5(chunk) if as_hash else chunk).alias("chunk"), (((span.n > 1) | span.long) & (F.length(chunk) >= span.n)).alias("counts"), (n_words(chunk) if as_hash else F.lit(0)).alias("words"))

    spans = rows.select("id", "key", F.posexplode_outer(F.transform("spans", told)).alias("place", "told"))
    return spans.filter("told.counts").select("id", "key", "place", F.col("told.chunk").alias("chunk"), F.col("told.words").alias("words"))


def remove_repeated_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its text less the chunks that occurred before, n_lines and n_removed (lines), and words_removed.

    The first occurrence is that with the least (doc_id, place); a null doc_id comes first. Rows with one doc_id
    count as one document, so equal rows keep the same chunks. A null or empty text is one empty line and becomes
    empty; a text of which nothing is left becomes empty too. An empty table gives an empty result. A column named
    as a computed one gives way to it. Two different chunks of one hash, should they occur, both stay.
    """
    rows = chunked(df, doc_id, text)
    found = occurrences(rows)
    hashed = occurrences(rows, as_hash=True)
    if isinstance(df.schema[doc_id].dataType, T.IntegralType):  # as one number, which aggregates by hash
        order = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(-(2**63)).cast("decimal(20,0)")) * F.lit(2**32).cast("decimal(10,0)") + F.col("place").cast("decimal(10,0)")
    else:
        order = F.struct("id", "place")
    groups = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))
    repeated = groups.groupBy(F.md5("chunk").alias("hash")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("times").alias("times"), F.min("first").alias("first")).filter((F.col("chunks") == 1) & (F.col("times") > 1))
    repeated = cut(repeated)  # so that the rows of a chunk that very many documents have can be split in the join
    later = hashed.select("id", "key", "place", "words", F.col("chunk").alias("hash"), order.alias("order")).join(repeated.select("hash", "first"), "hash").filter(F.col("order") > F.col("first"))
    # As a set, since repeated rows of one document have each chunk as often.
    gone = later.groupBy("id", "key").agg(F.collect_set(F.struct("place", "words")).alias("gone"))
    gone = gone.select("id", "key", F.col("gone.place").alias("gone"), F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, x: n + x.words).alias("words"))
    kept = [c for c in df.columns if c not in (text, "n_lines", "n_removed", "words_removed")]
    body = F.coalesce(F.col(f"d.`{text}`").cast("string"), F.lit(""))
    out = df.alias("d").join(gone.alias("g"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.id")) & (F.md5(body) == F.col("g.key")), "left")
    out = out.select(*[F.col(f"d.`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col("g.gone").alias("gone"), F.coalesce("g.words", F.lit(0).cast("bigint")).alias("words_removed"), F.split(body, "\n").alias("all"))
    out = with_spans(out.withColumn("lines", F.when(F.col("gone").isNotNull(), F.col("all")).otherwise(F.array())))
    stays = F.filter(F.transform("spans", lambda s, i: F.struct(s.at.alias("at"), s.n.alias("n"), i.alias("i"))), lambda s: ~F.array_contains("gone", s.i))
    left = F.flatten(F.transform(stays, lambda s: F.slice("lines", s.at, s.n)))
    out = out.withColumn("left", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("all")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.array_join("left", "\n").alias(text), F.size("all").cast("bigint").alias("n_lines"), (F.size("all") - F.size("left")).cast("bigint").alias("n_removed"), "words_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line, ('0x' || md5(u.line)[1:8])::BIGINT AS v, len(regexp_extract_all(u.line, '[^\\x20\\x09-\\x0D]+')) > {PASSAGE_WORDS} AS long
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
       LATERAL (SELECT unnest(l) AS line, unnest(range(len(l))) AS i) u),
rolled AS (
  SELECT *, v + {WEIGHT} * coalesce(lag(v) OVER w, 0) AS r, lag(long) OVER w AS long_before, lead(long) OVER w AS long_after, lead(long, 2) OVER w AS long_second
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (
  SELECT *, coalesce(long OR coalesce(long_after, false) OR (NOT long_before AND NOT long_after AND NOT long_second AND r < lag(r) OVER w AND r <= lead(r) OVER w), false) AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
  SELECT doc_id, i, line, long, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM marked),
chunks AS (
  SELECT doc_id, place, count(*) AS n, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, place),
ranked AS (
  SELECT *, (n > 1 OR long) AND length(replace(chunk, chr(10), '')) > 0 AS counts FROM chunks),
judged AS (
  SELECT doc_id, place, n, chunk, counts AND row_number() OVER (PARTITION BY counts, chunk ORDER BY doc_id, place) > 1 AS gone FROM ranked),
left_over AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM left_over
"""


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the chunks that an earlier one has; n_chars follows the new text.

    A document of which COPY_PERCENT hundredths of the words or more are such chunks is a copy and goes whole, as what is left
    of it would pass for a text of its own. One without words stays as it is: nothing of it was removed. Null texts
    become empty; rows of one doc_id count as one document where they repeat each other; an empty table gives an empty
    result; all other columns, whatever their names, pass through.
    """
    before = "words_before_line_dedup"
    named = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, named, strict=True))
    body = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], n_words(body).alias(before))
    out = remove_repeated_chunks(inner, own["doc_id"], own["text"])
    # Told by the words removed: a condition on the words left would have Spark make each text's chunks again and again.
    out = out.filter((F.col(before) == 0) | (100 * F.col("words_removed") < COPY_PERCENT * F.col(before)))
    return out.select(*[(F.length(own["text"]).cast("bigint") if c == "n_chars" else F.col(n)).alias(c) for c, n in own.items()])
