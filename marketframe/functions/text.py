"""Text cleaning and English detection (F1-F9, P5, P6) as JVM-side column expressions.

Python's ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware while Java's are ASCII by default, so the
patterns spell the classes out: word = ``[\\p{L}\\p{N}_]``, space = the characters Python's
``str.isspace`` accepts. Word boundaries are written as look-arounds on the word class.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.schemas import ENGLISH_KEYWORDS

WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"

# The cleaning patterns, in the order they are applied.
RT_PREFIX = rf"^RT[{SPACE}]+"
URL = rf"http[^{SPACE}]+|www\.[^{SPACE}]+"
ETH_WALLET = rf"(?<![{WORD}])0x[a-fA-F0-9]{{40}}(?![{WORD}])"
BTC_WALLET = rf"(?<![{WORD}])[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}(?![{WORD}])"
MENTION = rf"@[{WORD}]+"
HASHTAG = rf"#[{WORD}]+"
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+")
PUNCT = r"([!?.,()])"
SPACES = rf"[{SPACE}]+"
NON_WORD = rf"[^{WORD}]+"
ASCII_TOKEN = rf"(?<![{WORD}])[a-z]+(?![{WORD}])"

MIN_CHARS = 10
MIN_WORDS = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unescape_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if isinstance(t, str) else t)


def html_decode(c) -> Column:
    """F1 as a column: HTML entity decode with an Arrow-batched pandas UDF (no built-in
    exists). Spark evaluates a Python UDF for every row even under a condition; to keep rows
    without ``&`` in the JVM use :func:`html_decode_rows`."""
    c = _c(c)
    unescape = F.pandas_udf(_unescape_batch, "string")
    return F.when(c.contains("&"), unescape(c)).otherwise(c)


def html_decode_rows(df: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """F1 on a DataFrame, in one pass: texts without ``&`` reach the pandas UDF as NULL and keep
    their value in the JVM."""
    out = out or text
    unescape = F.pandas_udf(_unescape_batch, "string")
    has = F.col(text).contains("&")
    return df.withColumn(out, F.coalesce(unescape(F.when(has, F.col(text))), F.col(text)))


def clean_text(c, decode_html: bool = True) -> Column:
    """F1-F8: the cleaning chain in the reference's order; returns the cleaned text."""
    t = _c(c)
    if decode_html:
        t = html_decode(t)
    t = F.regexp_replace(t, RT_PREFIX, "")
    t = F.regexp_replace(t, URL, "")
    t = F.regexp_replace(t, ETH_WALLET, "")
    t = F.regexp_replace(t, BTC_WALLET, "")
    t = F.regexp_replace(t, MENTION, "")
    t = F.regexp_replace(t, HASHTAG, "")
    t = F.regexp_replace(t, EMOJI, "")
    t = F.regexp_replace(t, PUNCT, " $1 ")
    t = F.trim(F.regexp_replace(t, SPACES, " "))
    return t


def passes_quality(c) -> Column:
    """At least 10 characters and at least 3 whitespace-separated words."""
    t = _c(c)
    return (F.length(t) >= MIN_CHARS) & (F.size(F.split(t, " ")) >= MIN_WORDS)


def clean_or_null(c, decode_html: bool = True) -> Column:
    """F1-F8 + P6: cleaned text, or NULL when it fails the quality filter (or is NULL)."""
    t = clean_text(c, decode_html)
    return F.when(_c(c).isNotNull() & passes_quality(t), t)


def clean_keep(df: DataFrame, text: str = "text", out: str = "cleaned_text", keep=None,
               decode_html: bool = True) -> DataFrame:
    """F1-F8 + P6 as a flatMap: rows whose cleaned text passes (and ``keep``, if given) are kept
    with the text in ``out``; the others are dropped.

    The cleaned value goes through ``explode`` of a 0/1-element array. A filter on a plain
    derived column would be pushed by Catalyst below the projection (and below a repartition
    into the scan), evaluating the whole regex chain twice; a generator is a barrier, so the
    chain runs once, after the rows are spread.
    """
    t = clean_text(text, decode_html)
    if keep is not None:
        t = F.when(_c(keep), t)
    d = df.withColumn("_clean", t)  # computed once; the checks below only reference it
    c = F.col("_clean")
    ok = _c(text).isNotNull() & c.isNotNull() & passes_quality(c)
    d = d.withColumn(out, F.explode(F.filter(F.array(F.when(ok, c)), lambda x: x.isNotNull())))
    return d.drop("_clean")


def not_blank(c) -> Column:
    """P5: text present and not only white space (what Python's ``strip`` removes)."""
    return F.coalesce(_c(c), F.lit("")).rlike(f"[^{SPACE}]")


def ascii_tokens(c) -> Column:
    """Lower-case tokens that are entirely ``[a-z]`` (Python ``\\b[a-z]+\\b`` on Unicode text):
    one regex pass with Unicode word-boundary look-arounds."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(ASCII_TOKEN), 0)


def keyword_hits(tokens: Column, words) -> Column:
    """Number of tokens (with multiplicity) in ``words``; ``isin`` becomes a hash-set lookup."""
    words = list(words)
    return F.size(F.filter(tokens, lambda x: x.isin(words)))


def english_stats(c) -> tuple[Column, Column]:
    """(token count, keyword hits) of the English detector."""
    toks = ascii_tokens(c)
    return F.size(toks), keyword_hits(toks, ENGLISH_KEYWORDS)


def english_rule(text, n_tokens, n_hits, ratio: float = 0.3, few: int = 5) -> Column:
    """F9 decision from precomputed token and hit counts."""
    t, n, hits = _c(text), _c(n_tokens), _c(n_hits)
    rule = F.when(n < few, hits > 0).otherwise((hits / n) >= F.lit(float(ratio)))
    return F.when(t.isNull() | (F.length(t) < 3), F.lit(False)).otherwise(rule)


def is_english(c, ratio: float = 0.3, few: int = 5) -> Column:
    """fewer than ``few`` tokens -> any keyword hit; else hits / tokens >= ratio.
    Texts shorter than 3 characters (or NULL) are not English."""
    n, hits = english_stats(c)
    return english_rule(c, n, hits, ratio, few)


def with_english(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_hits and is_english, tokenising each text once (the token array is a
    column of its own, so it is not re-derived for the count and the hits)."""
    d = df.withColumn("_toks", ascii_tokens(text))
    d = d.withColumns({"n_tokens": F.size("_toks").cast("long"),
                       "n_hits": keyword_hits(F.col("_toks"), ENGLISH_KEYWORDS).cast("long")})
    return d.drop("_toks").withColumn("is_english", english_rule(text, "n_tokens", "n_hits"))
