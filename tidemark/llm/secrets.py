"""Secrets in texts: fixed forms, and high Shannon entropy in sliding windows.

Everything is a column expression. Positions come from splitting a text at the
matches of a pattern: each match starts where the pieces and matches before it
end. A window moves over a candidate one character at a time and keeps the sum of
``c * log2(c)`` over its character counts; a step changes the counts of the
character that leaves and the one that enters only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.common import filled

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"

# The forms that are always secrets.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Kinds in their order at equal starts.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")
#: Character classes: kind, candidate pattern, window, least bits per character.
CLASSES = (("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 3.0), ("entropy_text", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9))

# Marks of a made-up string; a window that holds one is no secret, those beside it may be.
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|sample|your_|0123456789|abcdefghij|(.)\1{7}"
# Digests of the empty text, anywhere in a span.
KNOWN_DIGEST = "d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb924"
# A whole candidate string that is a UUID.
WHOLE_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _empty() -> Column:
    return F.array().cast(SPANS)


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind")
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,hit,value>> of the leftmost non-overlapping matches; code points, end exclusive.

    ``hit`` is the match, ``value`` its ``group``.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    kind = "array<struct<start:int,end:int,hit:string,value:string>>"

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.length(part["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("hit"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).cast(kind).alias("found"))

    # The last piece has no match after it.
    parts = F.filter(zipped, lambda part: part["hit"].isNotNull())
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step, lambda state: state["found"])


def _cost(count: Column) -> Column:
    """c * log2(c), 0 for no or one occurrence."""
    return F.when(count < 2, F.lit(0.0)).otherwise(count * F.log2(count))


def entropy_spans(string: Column, window: int, least: float) -> Column:
    """array<struct<start,end>>: the merged windows whose characters carry ``least`` bits each or more and hold no placeholder."""
    kind = "array<struct<start:int,end:int>>"

    def count(inside: Column, char: Column) -> Column:
        return F.length(inside) - F.length(F.replace(inside, char, F.lit("")))

    def closed(state: Column) -> Column:
        last = F.array(F.struct(state["from"].alias("start"), state["to"].alias("end")))
        return F.when(state["to"] < 0, state["done"]).otherwise(F.concat(state["done"], last)).cast(kind)

    def step(state: Column, char: Column) -> Column:
        full = F.length(state["inside"]) == window
        leaving = count(state["inside"], F.substring(state["inside"], 1, 1))
        rest = F.when(full, F.substring(state["inside"], 2, window)).otherwise(state["inside"])
        entering = count(rest, char)
        left = F.when(full, _cost(leaving) - _cost(leaving - 1)).otherwise(F.lit(0.0))
        total = state["total"] - left + _cost(entering + 1) - _cost(entering)
        at = state["at"] + 1
        hot = (at >= window) & (F.lit(math.log2(window)) - total / window >= least - 1e-9) & ~F.concat(rest, char).rlike(PLACEHOLDER)
        joins = (state["to"] >= 0) & (at - window <= state["to"])
        return F.struct(
            F.concat(rest, char).alias("inside"),
            total.alias("total"),
            at.alias("at"),
            F.when(hot & ~joins, at - window).otherwise(state["from"]).alias("from"),
            F.when(hot, at).otherwise(state["to"]).alias("to"),
            F.when(hot & ~joins, closed(state)).otherwise(state["done"]).cast(kind).alias("done"),
        )

    start = F.struct(
        F.lit("").alias("inside"), F.lit(0.0).alias("total"), F.lit(0).alias("at"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(kind).alias("done")
    )
    return F.aggregate(F.split(string, "", -1), start, lambda s, c: F.when(c == "", s).otherwise(step(s, c)), closed)


def _guarded(text: Column, pattern: str, spans: Column) -> Column:
    """``spans``, worked out only where ``pattern`` occurs."""
    return F.when(text.rlike(pattern), spans.cast(SPANS)).otherwise(_empty())


def assigned(text: Column) -> Column:
    """Values of six or more characters assigned to a telling name."""
    found = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE_CHARS)
    return _guarded(text, r"(?i)passw|secret|token|api_?key", F.transform(found, lambda m: _span(m["start"], m["end"], "assign")))


def access_keys(text: Column) -> Column:
    """Access key ids of 20 or more characters."""
    return _guarded(text, ACCESS, F.transform(matches(text, ACCESS), lambda m: _span(m["start"], m["end"], "access")))


def hex_runs(text: Column) -> Column:
    """Runs of 24 or more lower-case hex digits."""
    return _guarded(text, HEX, F.transform(matches(text, HEX), lambda m: _span(m["start"], m["end"], "hex")))


def high_entropy(text: Column, kind: str, pattern: str, window: int, least: float) -> Column:
    """Parts of a character class with high entropy that hold both digits and letters and are not allow-listed."""

    def inside(match: Column) -> Column:
        def wanted(span: Column) -> Column:
            string = F.substr(match["hit"], span["start"] + 1, span["end"] - span["start"])
            return string.rlike("[0-9]") & string.rlike("[A-Za-z]") & ~string.rlike(KNOWN_DIGEST) & ~match["hit"].rlike(WHOLE_UUID)

        spans = F.filter(entropy_spans(match["hit"], window, least), wanted)
        return F.transform(spans, lambda s: _span(match["start"] + s["start"], match["start"] + s["end"], kind))

    return _guarded(text, pattern, F.flatten(F.transform(matches(text, pattern), inside)))


def with_secrets(docs, text_col: str = "text", prefix: str = ""):
    """``docs`` with the columns ``base_secrets`` and ``secrets``: arrays of (start, rank, end, kind) by start, then kind.

    ``secrets`` adds to ``base_secrets`` the high-entropy spans that lie in no base
    span. Null and empty texts have none. ``prefix`` is put before both names, for
    tables that have columns of these names already; rows are neither dropped nor
    merged, and other columns stay as they are.
    """
    text = filled(text_col)
    parts = {f"{prefix}found_{kind}": f(text) for kind, f in (("assign", assigned), ("access", access_keys), ("hex", hex_runs))}
    parts |= {f"{prefix}found_{kind}": high_entropy(text, kind, *rest) for kind, *rest in CLASSES}
    found = docs.withColumns(parts)
    base = F.array_sort(F.concat(*(F.col(f"{prefix}found_{kind}") for kind in KINDS[:3])))
    found = found.withColumn(f"{prefix}base_secrets", base)

    def outside(span: Column) -> Column:
        return ~F.exists(F.col(f"{prefix}base_secrets"), lambda b: (b["start"] <= span["start"]) & (b["end"] >= span["end"]))

    added = F.filter(F.concat(*(F.col(f"{prefix}found_{kind}") for kind in KINDS[3:])), outside)
    found = found.withColumn(f"{prefix}secrets", F.array_sort(F.concat(f"{prefix}base_secrets", added)))
    return found.drop(*parts)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each group of overlapping spans replaced by ``mark``."""

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        clear = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.when(new, F.concat(state["out"], clear, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
