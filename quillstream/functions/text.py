"""Cleaning of text: tags, white space, boilerplate lines, tokens. All but entity decoding stays in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that match one of these are boilerplate.
BOILERPLATE = ["cookie", "all rights reserved", "privacy policy", "copyright", "sitemap", "disclaimer"]
#: Tokens that are noise, beginnings that make a token an arrow, and the commonest English function words.
NOISE = ["ccp", "up", "↑", "▲", "⬆️", "a", "an", "at", "by", "in", "of", "on", "to", "the"]
ARROWS = ["↑", "▲", "⬆"]
STOP_WORDS = "a an and are as at be but by for from has have in is it its not of on or that the this to was were will with you your".split()


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references to characters; the one step of cleaning that has no built-in function."""
    return texts.map(html.unescape, na_action="ignore")


def decoded(text: Column) -> Column:
    """As unescape, but texts without ``&`` never leave the JVM's expression for another meaning: they come back as they are."""
    return F.when(F.contains(text, F.lit("&")), unescape(text)).otherwise(text)


def common_entities(text: Column) -> Column:
    """The five predefined references and the space, in plain expressions; ``&amp;`` last, so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    """White space, as Unicode has it, to single spaces; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_tags(text: Column, decode=decoded) -> Column:
    """Tags to spaces, references decoded, runs of white space to one space, trimmed."""
    plain = decode(F.regexp_replace(text, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s{2,}", " "))


def html_to_lines(text: Column, decode=decoded) -> Column:
    """Ends of block elements to line ends, other tags removed, blank lines dropped."""
    broken = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table)\s*>", "\n")
    plain = decode(F.regexp_replace(broken, r"<[^>]+>", ""))
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def tidy(text: Column) -> Column:
    """At most one blank line, single spaces, none around line ends; empty is NULL."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[\t\x0b\f\r ]+", " ")
    return F.nullif(F.trim(F.regexp_replace(text, r" *\n *", "\n")), F.lit(""))


def useful_lines(text: Column, longer_than: int = 1) -> Column:
    """Trimmed lines longer than this, without boilerplate, the first of equal ones, in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (F.length(x) > longer_than) & ~F.lower(x).rlike("|".join(BOILERPLATE)))
    return F.array_join(F.array_distinct(kept), "\n")


def useful_tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case tokens of more than two characters that are neither noise nor stop words nor begin with an arrow."""
    tokens = F.split(F.lower(text), r"\s+")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.rlike(f"^({'|'.join(ARROWS)})"))
    return F.filter(kept, lambda t: ~t.isin([*stop_words, *NOISE]))


def is_consent_page(html_text: Column) -> Column:
    return F.contains(html_text, F.lit('id="consent-page"')) & F.contains(html_text, F.lit("originalDoneUrl"))
