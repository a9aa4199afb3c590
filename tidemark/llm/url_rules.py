"""URL filters: host rules and indexed pattern rules.

A host rule ``HOST/PATH`` fits its host and all subdomains if the URL's path
starts with ``/PATH``; the longest that fits decides.  Where none does,
pattern rules do.  A pattern may begin with ``||`` (a host label begins here)
or ``|`` (the URL begins here) and end with ``|`` (it ends here); ``*`` is any
text, ``^`` a character other than ``a-z 0-9 _ . % -`` or the end; the rest
stands for itself, in either case.

Each pattern is filed under one of its literal tokens, the one that occurs in
the fewest URLs, counted over all of them.  A URL's tokens fetch the patterns
filed under them, and only those run as regular expressions.  A token counts
only if the pattern shows both its ends; patterns without one are filed under
the empty token, which every URL has.  ``allow`` beats ``block``.

Defined results: a NULL URL, or one without ``://``, has empty host and path
and no host rule; patterns still see the URL (a NULL one as empty); without
any match the verdict is ``default``; repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

BROADCAST_RULES = 20_000  # more pattern rules than these are joined without a hint

HOST_RULES = (  # rule, verdict: the contract's
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
    ("com/de/", "block"))
PATTERNS = (
    ("||spam-farm.", "block"), ("||adserver.", "block"), ("||casino.", "block"), ("/ads/", "block"),
    ("/tracker/*.gif|", "block"), ("^popup=1^", "block"), ("/phishing^", "block"), ("||trusted.example.net/ads/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lower_ascii(host), path


def host_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, ties by name, as a struct of rule and verdict."""
    entries = F.array(*[
        F.struct(F.lit(-len(rule)).alias("rank"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
                 F.lit(rule.partition("/")[0]).alias("host"), F.lit("/" + rule.partition("/")[2]).alias("path"))
        for rule, verdict in rules])
    fits = F.filter(entries, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    return F.array_min(fits)


def compile_patterns(patterns: DataFrame) -> DataFrame:
    """``pattern, verdict`` -> also ``regex`` and ``tokens``."""
    p = lower_ascii(F.col("pattern"))
    label, start, end = F.startswith(p, F.lit("||")), F.startswith(p, F.lit("|")), F.endswith(p, F.lit("|"))
    body = F.regexp_replace(F.regexp_replace(p, r"^\|\|?", ""), r"\|$", "")
    regex = F.regexp_replace(body, r"([\\.+?$()\[\]{}|])", r"\\$1")
    regex = F.replace(F.replace(regex, F.lit("*"), F.lit("[\\s\\S]*")), F.lit("^"), F.lit("(?:[^a-z0-9_.%-]|$)"))
    regex = F.concat(F.when(label, F.lit(r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?")).when(start, F.lit("^")).otherwise(""),
                     regex, F.when(end, F.lit("$")).otherwise(""))
    # the pattern with its open ends as wildcards
    open_ = F.concat(F.when(start, "|").otherwise("*"), body, F.when(end, "|").otherwise("*"))
    tokens = F.regexp_extract_all(open_, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0))
    return patterns.select("pattern", "verdict", regex.alias("regex"), F.array_distinct(tokens).alias("tokens"))


def url_tokens(url: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def judge(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow",
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` (the pattern that
    decided, or NULL), one row per page."""
    spark = pages.sparkSession
    small = F.broadcast if len(patterns) <= BROADCAST_RULES else (lambda df: df)
    rules = compile_patterns(spark.createDataFrame(list(patterns), "pattern string, verdict string"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn(
        "path", path)
    best = host_rule(F.col("host"), F.col("path"), host_rules) if host_rules else F.lit(None).cast(
        "struct<rule:string,verdict:string>")
    rows = rows.select("*", best.alias("best")).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"),
        F.monotonically_increasing_id().alias("row"))

    # in how many URLs each token of the rules occurs: partial counts, a row a token
    wanted = small(rules.select(F.explode("tokens").alias("token")).distinct())
    seen = (pages.select(F.explode(url_tokens(F.col(url))).alias("token")).join(wanted, "token")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    index = (rules.select("pattern", "verdict", "regex", F.explode_outer("tokens").alias("token"))
             .join(seen, "token", "left")
             .groupBy("pattern", "verdict", "regex")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
                  .alias("rarest"))
             .select("pattern", "verdict", "regex", F.col("rarest.token").alias("token")))

    fetched = (rows.withColumn("token", F.explode(url_tokens(F.col("url"))))
               .join(small(index), "token", "left")
               .withColumn("hit", F.when(
                   F.rlike(lower_ascii(F.coalesce("url", F.lit(""))), F.col("regex")),
                   F.struct(F.col("verdict"), F.col("pattern")))))
    kept = ["page_id", "host", "path", "rule", "rule_verdict"]
    found = fetched.groupBy("row").agg(*(F.first(c).alias(c) for c in kept), F.min("hit").alias("hit"))
    free = F.col("rule").isNull()
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce("rule_verdict", "hit.verdict", F.lit(default)).alias("verdict"),
                        F.when(free, F.col("hit.pattern")).alias("pattern"))
