"""Text expressions: tokens, sentences, citations. Column to column, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searching leaves out (fixed values).
STOPWORDS = (
    "a an and are as at be but by for from has have he her hers him his how i if in into is it its me my not of on or our ours she so some such than that the their "
    "them then there these they this those to too us was we were what when where which who whom why will with you your yours"
).split()
#: A word of the search index: ASCII letters and digits, with single separators inside (fixed value).
WORD = r"[A-Za-z0-9]+(?:[.,'][A-Za-z0-9]+)*"
#: Where a sentence ends: after ! ? or a full stop that ends no abbreviation, with closing signs, before a capital letter, digit or bracket.
SENTENCE_END = r"""((?:[!?]|(?<!(?<![A-Za-z])(?i:dr|mr|mrs|ms|prof|sr|jr|vs|etc))\.)['"”’)\]}]*)\s*(?=[\p{Lu}\p{Nd}\[(]|$)"""
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Index terms in order, repeated ones kept; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))  # a set look-up


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def approx_tokens(text: Column) -> Column:
    return F.size(words(text))


def squeeze(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.array_join(words(text), " ")


def sentences(text: Column) -> Column:
    """Sentences of an answer; blank text gives none."""
    cut = F.regexp_replace(squeeze(text), SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def citations(sentence: Column) -> Column:
    """The numbers cited, in order, repeated ones kept: [1], [2, 3]."""
    groups = F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda n: F.trim(n).cast("bigint"))


def strip_citations(sentence: Column) -> Column:
    return squeeze(F.regexp_replace(sentence, CITATION, ""))


def looks_factual(sentence: Column) -> Column:
    """Not empty, no question, with a letter."""
    bare = strip_citations(sentence)
    return (bare != "") & ~bare.endswith("?") & bare.rlike("[A-Za-z]")


def indexed_text(title: Column, text: Column) -> Column:
    """What is embedded and indexed of a chunk: its section's title, a blank line, its text."""
    return F.when(F.length(title) > 0, F.concat_ws("\n\n", title, text)).otherwise(text)
