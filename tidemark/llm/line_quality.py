"""Quality rules on lines that many documents of a host share.

A line's key hashes its host (a column) with its normalised text (A-Z
lower-cased, digits as 0, white space as one space).  Documents whose lines
have the same keys in the same order are copies and count once, so copies of a
document don't make its lines boilerplate.  Lines with more than ``LIMIT``
distinct documents are removed; a document is rejected (depleted) if fewer than
``LEAST_WORDS`` of its words are left, or less than ``LEAST_SHARE`` of them.

Base figures need no exchange: they are array functions over the one text.
Lines travel as a key and a word count.

Defined results: NULL text has no words; a NULL host is a host of its own;
rows equal in all columns stay and count as one document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, clear_name, lower_ascii, numbered, word_array
from tidemark.session import materialize

LIMIT = 50
LEAST_WORDS = 5
LEAST_SHARE = 0.2
WINDOW = 8


def repeated_words(order: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more; ``order``: a column with a
    struct of hash and place for every window, sorted."""
    n = F.size(order)
    twice = F.filter(order, lambda x, k: ((k > 0) & (F.get(order, k - 1)["h"] == x["h"]))
                     | ((k < n - 1) & (F.get(order, k + 1)["h"] == x["h"])))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(window), s - acc["last"])).alias("n"), s.alias("last")))
    return covered["n"]


def line_key(host: Column, line: Column) -> Column:
    """60 bits of the MD5 of host and normalised line."""
    text = F.regexp_replace(F.translate(lower_ascii(line), "0123456789", "0000000000"), SPACES, " ")
    whole = F.concat(F.coalesce(F.concat(F.lit("="), host), F.lit("")), F.lit("\n"), F.trim(text))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source",
             row: str | None = None) -> DataFrame:
    """Base figures of every row and its ``lines`` (key, words), without the
    text, written once; ``row`` is the given column, else a number."""
    d = docs.select(F.col(row) if row else F.monotonically_increasing_id(), F.col(doc_id).alias("doc_id"),
                    F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.toDF("row", "doc_id", "host", "t")
    d = d.withColumn("words", word_array(F.col("t"))).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("windows", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    count = F.col("n_words")
    # the rare text with a repeated window gets them sorted; a column of its own, as each is looked up by place
    places = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("order", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(places)))
    n_repeat = F.coalesce(repeated_words(F.col("order")), F.lit(0))
    d = d.select(
        "row", "doc_id", "n_words",
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(
            line_key(F.col("host"), x).alias("key"), F.size(word_array(x)).alias("words"))).alias("lines"))
    return materialize(d.withColumn("base_failed", (count < 20) | (100 * F.col("n_repeat_words") > 30 * count)))


def frequent_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Keys of lines in more than ``limit`` documents; copies (all their line
    keys are equal, in the same order) count as one."""
    keys = rows.select(F.transform("lines", lambda x: x["key"]).alias("keys"))
    # the digest of its own select: beside explode it would be taken anew for every line
    seen = (keys.select(F.xxhash64("keys").alias("whole"), F.array_distinct("keys").alias("keys"))
            .select("whole", F.explode("keys").alias("key")))
    return (seen.groupBy("key").agg(F.countDistinct("whole").alias("n"))
            .where(F.col("n") > limit).select("key"))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", limit: int = LIMIT,
          least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``doc_id``, the base figures,
    ``base_failed``, ``n_removed_words``, ``kept``."""
    rows = measured(docs, text, doc_id, host, row)
    frequent = materialize(frequent_lines(rows, limit))
    removed = (rows.select("row", F.explode("lines").alias("l")).select("row", "l.key", "l.words")
               .join(frequent, "key").groupBy("row").agg(F.sum("words").alias("n_removed_words")))
    out = rows.drop("lines").join(removed, "row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected rows, all columns kept."""
    row = clear_name("_row", docs.columns)
    whole = numbered(docs, row)
    keep = judge(whole, text, doc_id, host, row=row, **limits).where("kept").select(F.col("row").alias(row))
    return whole.join(keep, row, "left_semi").select(docs.columns)


def without_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Texts without their frequent lines, all columns kept; needs a unique
    ``row`` column."""
    lines = (docs.select("row", F.col(host).alias("h"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                         .alias("at", "line"))
             .withColumn("key", line_key(F.col("h"), F.col("line"))))
    rest = (lines.join(frequent, "key", "left_anti").groupBy("row")
            .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
            .select("row", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("_rest")))
    return docs.join(rest, "row", "left").withColumn(text, F.coalesce("_rest", F.lit(""))).select(docs.columns)
