"""Hits inside percent-encoded and base64 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import detect
from .text import FLAGS, let, replace_matches, spans

BASE64_RUN = r"[A-Za-z0-9+/]{16,}={0,2}"
_PERCENT_WORD = r"\S*%[0-9A-Fa-f]{2}\S*"


def url_decoded(text: Column, whole: bool = False) -> Column:
    """The percent-decoded text; null where nothing was encoded or (whole) one bad escape spoils it."""
    bad = "�"
    if whole:
        out = F.try_url_decode(text)
        return F.when(text.contains("%") & ~F.coalesce(out.contains(bad), F.lit(True)), out)

    def word(m: Column) -> Column:
        out = F.try_url_decode(m)
        return F.when(F.coalesce(out.contains(bad), F.lit(True)), m).otherwise(out)

    return F.when(text.rlike("%[0-9A-Fa-f]{2}"), replace_matches(text, FLAGS + _PERCENT_WORD, word))


def url_encoded(v: Column) -> Column:
    """Unreserved characters stay, a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_hits(text: Column, section: Column | None = None, key_path: Column | None = None, whole: bool = False) -> Column:
    """Hits of the decoded view; their value is the encoded form."""
    none = F.array().cast(detect.HITS)
    hits = let(url_decoded(text, whole), lambda t: F.when(t.isNull(), none).otherwise(detect.scan(detect.Context(t, section, key_path))))
    return F.transform(hits, lambda h: h.withField("value", url_encoded(h["value"])))


def base64_decoded(blob: Column) -> Column:
    return F.try_validate_utf8(F.try_to_binary(blob, F.lit("base64")).try_cast("string"))


def base64_hits(text: Column, section: Column | None = None, key_path: Column | None = None) -> Column:
    """Hits inside base64 runs; value and span are the whole run."""

    def inside(x: Column) -> Column:
        hits = let(base64_decoded(x["m"]), lambda t: F.when(t.isNull(), F.array().cast(detect.HITS)).otherwise(detect.scan(detect.Context(t, section, key_path))))
        start = x["start"]
        return F.transform(hits, lambda h: h.withField("value", x["m"]).withField("start", start).withField("end", start + F.length(x["m"])))

    runs = spans(text, BASE64_RUN)
    return F.when(text.rlike("[A-Za-z0-9+/]{16}"), F.flatten(F.transform(runs, inside))).otherwise(F.array().cast(detect.HITS))


def scan_views(text: Column, section: Column | None = None, key_path: Column | None = None, dense: bool = False, views: str = "all") -> Column:
    """Hits of the literal, percent-decoded and base64 views (or of the literal one), each with its view."""
    named = lambda hits, view: F.transform(hits, lambda h: F.struct(F.lit(view).alias("view"), *(h[k].alias(k) for k in ("kind", "value", "canonical", "confidence", "start", "end"))))
    literal = detect.scan(detect.Context(text, section, key_path, dense))
    if views == "literal":
        return named(literal, "literal")
    return F.concat(named(literal, "literal"), named(url_hits(text, section, key_path), "url"), named(base64_hits(text, section, key_path), "base64"))
