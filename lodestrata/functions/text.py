"""Text expressions: cleaning, tokens, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequences that a wrong decoding leaves in place of punctuation, and what they stand for.
MOJIBAKE = [("â€™", "'"), ("â€“", "-"), ("â€”", "-"), ("â€œ", '"'), ("â€\x9d", '"'), ("ï‚·", "-")]
#: Words that say nothing about coverage.
COVERAGE_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or", "say", "said", "the", "they", "to", "was", "what", "when", "which", "who", "why"]
#: Words that say nothing about graph names.
GRAPH_STOPWORDS = ["a", "an", "and", "are", "as", "at", "by", "did", "does", "for", "from", "how", "include", "includes", "in", "is", "of", "on", "or", "the", "to", "what", "which"]
#: Endings that the graph tokens lose, tried in this order.
GRAPH_SUFFIXES = ["ing", "ates", "ate", "ated", "es", "s", "ed"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    text = F.replace(text, F.lit(" "), F.lit(" "))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\APage [0-9]+\n", "")
    text = F.regexp_replace(text, r"\nPage [0-9]+\n", "\n")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def sanitize_query(text: Column) -> Column:
    text = F.translate(F.coalesce(text, F.lit("")), "​﻿", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def index_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-&+.]*"), F.lit(0)), F.lower)


def coverage_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-+]*"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(COVERAGE_STOPWORDS))


def graph_text(text: Column) -> Column:
    text = F.lower(text)
    for bad, good in (("â€™", "'"), ("’", "'"), ("—", " "), ("–", " ")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9$%+\-./ ]+", " "), r"\s+", " "))


def graph_stem(token: Column) -> Column:
    out = F.when(F.length(token) <= 4, token)
    for s in GRAPH_SUFFIXES:
        out = out.when(token.endswith(s) & (F.length(token) - len(s) >= 4), token.substr(F.lit(1), F.length(token) - len(s)))
    return out.otherwise(token)


def graph_tokens(text: Column) -> Column:
    kept = F.filter(F.split(graph_text(text), " "), lambda x: (x != "") & ~x.isin(GRAPH_STOPWORDS))
    return F.transform(kept, graph_stem)


def extraction_text(text: Column) -> Column:
    """Extracted names, evidence and passages as they are compared: like ``graph_text``, but dashes stay."""
    text = F.lower(text)
    for bad, good in (("â€™", "'"), ("’", "'"), ("—", "-"), ("–", "-")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9$%+\-./ ]+", " "), r"\s+", " "))


def clean_name(name: Column) -> Column:
    name = F.regexp_replace(stripped(name), r"\s+", " ")
    for bad, good in (("â€™", "'"), ("’", "'"), ("—", "-"), ("–", "-")):
        name = F.replace(name, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(name, r"\s+\([A-Z0-9&+/ -]{2,12}\)$", ""))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_name(name)), r"[^a-z0-9]+", " "))


def plain_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z0-9]+", " "))


def html_text(html: Column) -> Column:
    """Markup to clean text: script, style, comments and tags go, common entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return clean_text(text)
