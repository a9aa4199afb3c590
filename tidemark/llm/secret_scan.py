"""Secrets by patterns and by sliding-window entropy.

Base spans: assignments to names such as ``password``, access keys, long hex
strings.  Candidate strings are runs of one character class: hex digits with
letters and digits, or base-64 characters with upper, lower and digits.  Over
each candidate a window of ``WINDOW`` characters slides; its entropy is
log2(W) - S / W with S the sum of c log2 c over its character counts, and
a step changes S by the counts of the two characters that leave and enter.  A
candidate whose highest window reaches its class's threshold is a span
(``entropy``), unless it meets a base span or the allow-list says that it is
no secret: UUIDs, fillers (placeholders, runs such as 0123456789), paths and
words.  '/' and '=' are characters of base 64 too, and a filler may stand in a
key by chance: a path is allowed only if two thirds of its characters are in
parts like words, and neither a path nor a filler allows a candidate that has a piece
of ``WINDOW`` characters or more, between separators and fillers, which reaches
the threshold by itself.

All of it are array functions over one text; nothing is exchanged.  Positions
come from the lengths of the matches and of what lies between them.

Defined results: NULL text is empty; a document without spans has the digest
of the empty string and an empty ``spans``; rows equal in all columns stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hex_sha256, spans_text

WINDOW = 20
# fixed values: the base patterns; 32+ hex digits and 16+ characters of a key are the patterns' runs with their least length
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# class, candidate string, least entropy in bits of its best window
CLASSES = (
    ("hex", r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_=-])", 3.0),
    ("base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", 3.7),
)
# fixed values: candidates that are no secrets
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*[-_/=+]*$", r"^[0-9+/_=-]*$",
    r"^(?i)[a-z]+(?:[-_/][a-z]+)+[0-9]{0,4}$",
)
# fixed values: they allow a candidate if no piece of it is a secret by itself
FILLER = (r"(?i:example|sample|placeholder|changeme|dummy|redacted|xxxx|lorem"
          r"|0123456789|1234567890|abcdefgh|deadbeef|qwerty)")
PATH = r"^/|/.*/|//"
SEPARATORS = r"[/+_=-]+"
WORD = r"^(?=.{1,30}$)(?:[A-Z]{0,3}[a-z]+(?:[A-Z][a-z]{2,})*[0-9]{0,4}|[A-Z]{1,12}[0-9]{0,4}|[0-9]{1,8})$"


def located(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: structs of text, start and
    end in code points.  The pattern must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(
        F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out")),
        lambda acc, x: F.when(x["value"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                x["value"].alias("value"), (acc["at"] + x["gap"]).alias("start"),
                (acc["at"] + x["gap"] + F.length(x["value"])).alias("end")))).alias("out"))),
        lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))


def kind_spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value taken once: expressions inside a lambda are taken at every turn."""
    return F.transform(F.array(value), use)[0]


def _best_window(codes: Column, n_kinds: Column, window: int) -> Column:
    """Of character codes from 0.  The counts of the window's characters lie in
    longs, some bits a code; a step lowers one count and raises another."""
    bits = window.bit_length()
    per = 63 // bits
    zero = F.lit(0).cast("long")
    c_log_c = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def slot(code: Column) -> Column:
        return F.floor(code / per).cast("int")

    def shift(code: Column) -> Column:
        return (code % per) * bits

    def added(counts: Column, code: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", F.lit(sign).cast("long"), shift(code))
        return F.transform(counts, lambda held, k: held + F.when(k == slot(code), one).otherwise(zero))

    def count(counts: Column, code: Column) -> Column:
        held = F.call_function("shiftright", F.get(counts, slot(code)), shift(code))
        return held.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        n_gone = count(acc["counts"], x["gone"])
        n_new = count(acc["counts"], x["new"]) - (x["gone"] == x["new"]).cast("int")
        s = (acc["s"] - F.get(c_log_c, n_gone) + F.get(c_log_c, n_gone - 1) - F.get(c_log_c, n_new)
             + F.get(c_log_c, n_new + 1))
        return F.struct(s.alias("s"), F.least(acc["least"], s).alias("least"),
                        added(added(acc["counts"], x["gone"], -1), x["new"], 1).alias("counts"))

    def slide(counts: Column) -> Column:
        # S of the first window: every character adds log2 of its count
        s0 = F.aggregate(first, F.lit(0.0), lambda a, c: a + F.log2(count(counts, c).cast("double")))
        return F.aggregate(moves, _let(s0, lambda s: F.struct(s.alias("s"), s.alias("least"), counts.alias("counts"))),
                           step, lambda acc: acc["least"])

    n = F.size(codes)
    first = F.slice(codes, 1, window)
    n_moves = F.greatest(n - window, F.lit(0))
    moves = F.zip_with(F.slice(codes, F.lit(1), n_moves), F.slice(codes, F.lit(window + 1), n_moves),
                       lambda gone, new: F.struct(gone.alias("gone"), new.alias("new")))
    start = F.aggregate(first, F.array_repeat(zero, slot(n_kinds) + 1), lambda counts, c: added(counts, c, 1))
    width = F.least(n, F.lit(window)).cast("double")
    return F.log2(width) - _let(start, slide) / width


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """Of all windows of the string (all of it, if shorter), in bits a character."""
    return _let(F.split(value, ""), lambda chars: _let(F.array_distinct(chars), lambda kinds: _let(
        F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int")),
        lambda codes: _best_window(codes, F.size(kinds), window))))


def mixed(value: Column) -> Column:
    """It has letters and digits."""
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))


def allowed(value: Column, bits: float) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | F.rlike(value, F.lit(pattern))

    def chars(parts: Column) -> Column:
        return F.length(F.array_join(parts, ""))

    parts = F.split(F.regexp_replace(value, "^[^/=]*=(?=[^=])", ""), SEPARATORS)  # without an assignment's name
    words = F.filter(parts, lambda x: F.rlike(x, F.lit(WORD)))
    path = F.rlike(value, F.lit(PATH)) & (3 * chars(words) > 2 * chars(parts))
    secret = F.exists(F.split(value, f"{FILLER}|{SEPARATORS}"), lambda x: (F.length(x) >= WINDOW) & mixed(x)
                      & ~F.rlike(x, F.lit(WORD)) & (highest_entropy(x) >= bits))
    return out | ((F.rlike(value, F.lit(FILLER)) | path) & ~secret)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select(
        "doc_id", "t",
        F.filter(located(F.col("t"), ASSIGN), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= 8).alias("assign"),
        located(F.col("t"), ACCESS).alias("access"), located(F.col("t"), HEX).alias("hex"),
        *[F.filter(located(F.col("t"), pattern), lambda s, bits=bits: mixed(s["value"]) & ~allowed(s["value"], bits))
          .alias(f"{name}_strings") for name, pattern, bits in CLASSES]).drop("t")
    base = F.array_sort(F.concat(*[kind_spans(F.col(k), k, i) for i, k in enumerate(("assign", "access", "hex"))]))
    d = d.withColumn("base", base)
    more = [F.filter(F.col(f"{name}_strings"), lambda s, bits=bits: ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (highest_entropy(s["value"]) >= bits))
        for name, _, bits in CLASSES]
    found = F.array_distinct(F.concat(*[kind_spans(m, "entropy", 3) for m in more]))
    d = d.withColumn("more", found)
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        hex_sha256(spans_text(F.col("base"))).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_entropy"))
