"""Text operators as Column functions (T1-T8, T13-T20). All built-in expressions, but for NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that fold to several letters, and those that fold one to one.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
FOLD_FROM, FOLD_TO = "’“”–—", "'\"\"--"

# Words that keyword search leaves out.
STOPWORDS = (
    "a an and are as at be by can did do does for from has have how if in into "
    "is it its of on or that the their them they this to was we were what when "
    "where which who why will with"
).split()

# What the pattern (?U)\s matches.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# The characters that compatibility composition may change, and all beyond Latin-1, some of which it changes.
FORMS = r"[\xa0\xa8\xaa\xaf\xb2\xb3\xb4\xb5\xb8\xb9\xba\xbc\xbd\xbe\x{100}-\x{10ffff}]"

NOISE_CHARS = r"(?U)^[\d\s\-–.ivxlIVXL]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_chars(c: Column | str) -> Column:
    """Ligatures to letters, typographic quotes and dashes to ASCII."""
    t = _col(c)
    out = t
    for bad, good in LIGATURES.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(out, FOLD_FROM, FOLD_TO))


def strip(c: Column | str) -> Column:
    """T5: white space of any alphabet off both ends."""
    return F.btrim(_col(c), F.lit(WHITE))


def clean(c: Column | str) -> Column:
    """Fold, join hyphenated line ends, lines to spaces, runs of spaces to one, strip. Texts without line ends, tabs
    and double spaces skip the patterns, which change nothing else; folding neither adds nor takes any of these."""
    t, folded = _col(c), fold_chars(c)
    out = F.regexp_replace(folded, r"-\n(?=[a-z])", "")
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", " ")
    some = F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit("  "))
    return strip(F.when(some, F.regexp_replace(out, r"[ \t]{2,}", " ")).otherwise(folded))


def alpha_share(c: Column | str) -> Column:
    t = _col(c)
    return F.length(F.regexp_replace(t, r"\P{L}+", "")) / F.greatest(F.length(t), F.lit(1))


def is_noise(c: Column | str) -> Column:
    """Short, only numbers and roman numerals, or mostly not letters."""
    t = strip(c)
    return (F.length(t) < 25) | t.rlike(NOISE_CHARS) | (alpha_share(t) < F.lit(0.45))


def sentences(c: Column | str) -> Column:
    """Parts after . ! or ? and white space."""
    return F.split(_col(c), r"(?<=[.!?])(?U)\s+")


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, without stopwords; repeats stay."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


@cache
def nfkc():
    """Compatibility composition, which Spark has no function for. Made on first use, as workers import
    this module without a session."""

    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(compose, "string")


def collapse(c: Column | str) -> Column:
    """White space to single spaces, and off both ends; a single space is not replaced by itself."""
    return strip(F.regexp_replace(_col(c), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def normalise(c: Column | str) -> Column:
    """NFKC, lower case, white space collapsed. Texts without ``FORMS`` skip the Python step."""
    t = _col(c)
    plain = ~t.rlike(FORMS)
    return collapse(F.lower(F.when(plain, t).otherwise(nfkc()(F.when(~plain, t)))))


def citation_label(source: Column | str, page: Column | str) -> Column:
    """T16."""
    return F.concat(_col(source), F.lit(" p."), _col(page).cast("string"))


def cited_numbers(c: Column | str) -> Column:
    """The distinct numbers in bracketed lists such as [1] or [2, 3]."""
    lists = F.regexp_extract_all(_col(c), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.split(F.array_join(lists, ","), r"\s*,\s*"), lambda n: n.try_cast("int")))


def reason(body: Column | str) -> Column:
    """An error reply's own explanation, white space collapsed, at most 200 characters."""
    b = _col(body)
    said = F.coalesce(*[F.nullif(F.get_json_object(b, f"$.{k}"), F.lit("")) for k in ("message", "detail")], b)
    return F.coalesce(F.nullif(F.left(collapse(said), F.lit(200)), F.lit("")), F.lit("no details"))


def fixed(c: Column | str, digits: int = 3) -> Column:
    """T19."""
    return F.format_string(f"%.{digits}f", _col(c))


def page_labels(pages: Column | str) -> Column:
    """An array of (source, page) as one text."""
    return F.array_join(F.transform(_col(pages), lambda p: citation_label(p["source"], p["page"])), ", ")


def share(part: Column | str, whole: Column | str) -> Column:
    """M15: "m of n (p%)", 0 for an empty whole."""
    m, n = _col(part), _col(whole)
    p = F.coalesce(F.round(m / F.nullif(n, F.lit(0)) * 100, 1).cast("string"), F.lit("0"))
    return F.format_string("%d of %d (%s%%)", m.cast("long"), n.cast("long"), p)
