"""Titles, names, labels and times."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Latin letters and their Cyrillic look-alikes, for titles and for identifiers.
TITLE_LATIN, TITLE_CYRILLIC = "aeopcxybhtmk", "аеорсхувнтмк"
IDENT_LATIN, IDENT_CYRILLIC = "copaexy", "сораеху"
PUNCTUATION = "[\"'«»“”„`’‘()\\[\\]{}.,;:!?/\\\\|№#*+\\-–—_]+"
# Score bands (trigram, token set).
MATCH_BAND, AMBIGUOUS_BAND = (0.74, 0.80), (0.50, 0.72)


def fold(s: Column) -> Column:
    return F.translate(s, TITLE_LATIN, TITLE_CYRILLIC)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for; skip it where input is known to be composed."""
    return s.str.normalize("NFC")


def title_tokens(title: Column, strip_identifiers: bool = False, compose: bool = False) -> Column:
    """Lower-case folded words without punctuation; identifiers (digits, number signs) dropped on request."""
    s = F.coalesce(title, F.lit(""))
    s = fold(F.lower(nfc(s) if compose else s))
    if strip_identifiers:
        s = F.array_join(F.filter(F.split(s, "(?U)\\s+"), lambda t: ~t.rlike("[0-9№#]")), " ")
    s = F.regexp_replace(s, PUNCTUATION, " ")
    return F.filter(F.split(s, "(?U)\\s+"), lambda t: t != "")


def squash(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def trigrams(s: Column) -> Column:
    """Distinct 3-grams of the string padded by two blanks before and one after."""
    p = F.concat(F.lit("  "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def contained(a: Column, b: Column) -> Column:
    """One in the other, the shorter of 5 characters and 45 % of the longer at least."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    fits = (short >= 5) & (short >= 0.45 * long)
    return fits & (F.contains(a, b) | F.contains(b, a))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of the sorted distinct tokens, rounded as its double stands."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        return difflib.SequenceMatcher(None, " ".join(sorted(set(x))), " ".join(sorted(set(y)))).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def band(exact: Column, contain: Column, trigram: Column, token_set: Column) -> Column:
    """MATCH, AMBIGUOUS or NONE from scores rounded to four places."""
    tri, tok = F.round(trigram, 4), F.round(token_set, 4)
    return (
        F.when((exact == 1) | (contain == 1) | (tri >= MATCH_BAND[0]) | (tok >= MATCH_BAND[1]), "MATCH")
        .when((tri >= AMBIGUOUS_BAND[0]) | (tok >= AMBIGUOUS_BAND[1]), "AMBIGUOUS")
        .otherwise("NONE")
    )


def is_confidence_signal(band_: Column) -> Column:
    """Only a match may add confidence; the other bands are neutral."""
    return band_ == "MATCH"


def identifier(s: Column) -> Column:
    """Letters and digits of an identifier, lower case, look-alikes folded after the filter."""
    return F.translate(F.regexp_replace(F.lower(s), "[^0-9a-zа-я]", ""), IDENT_LATIN, IDENT_CYRILLIC)


def safe_filename(name: Column, most: int = 50) -> Column:
    s = F.regexp_replace(name, '[/\\\\:*?"<>|]', "-")
    s = F.regexp_replace(s, "^(?U:\\s)+|(?U:\\s)+$", "")
    return F.substring(F.regexp_replace(s, "(?U)\\s+", "_"), 1, most)


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("–"), last))


def unquote(s: Column) -> Column:
    return F.regexp_replace(s, "^(['\"])(.*)\\1$", "$2")


def clock_seconds(line: Column) -> Column:
    """Seconds of a leading HH:MM:SS; null without one."""
    part = lambda k: F.regexp_extract(line, "^(\\d{2}):(\\d{2}):(\\d{2})", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two clock times, over midnight if need be."""
    return F.pmod(end - start, F.lit(86400))


def hms(seconds: Column) -> Column:
    """1h 2m 3s, leading zero units left out."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return (
        F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s")))
        .when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def cache_key(prompt: Column) -> Column:
    """First 16 hex digits of the prompt's SHA-256."""
    return F.substring(F.sha2(prompt, 256), 1, 16)
