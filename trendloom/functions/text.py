"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.arrays import let

# Characters replaced in file names.
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*]'
# Fixed value: one token is a run of letters, digits and underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def sanitize_name(name: Column, max_length: int = 100) -> Column:
    """File-name-safe text: unsafe characters become ``_``, cut, never empty."""
    cut = F.substring(F.regexp_replace(name, UNSAFE_NAME_CHARS, "_"), 1, max_length)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown"))


def is_blank(text: Column) -> Column:
    """True for ``NULL`` and for text without any non-space character."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate(text: Column, max_length: int) -> Column:
    """Text cut to ``max_length`` characters, the last three being dots when cut."""
    cut = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def clean_name(name: Column, max_length: int = 255, overlong: str = "truncate") -> Column:
    """Strip white space and quotes, collapse inner white space.

    ``overlong='reject'`` gives ``NULL`` for names above the limit (used when a
    cluster is created), ``'truncate'`` cuts them (used when an insight fills a
    missing name).  An empty name is ``NULL`` in both modes.
    """
    if overlong not in ("truncate", "reject"):
        raise ValueError("overlong must be 'truncate' or 'reject'")
    bare = F.regexp_replace(strip(name), "^[\"']+|[\"']+$", "")
    one_spaced = F.nullif(strip(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))
    if overlong == "truncate":
        return truncate(one_spaced, max_length)
    return F.when(F.length(one_spaced) <= max_length, one_spaced)


def tokens(text: Column) -> Column:
    """Lower-case tokens in text order, one-character tokens kept.

    A capital i with dot becomes a plain i: in lower case it would be an i and a combining dot, which cuts the word in two.
    """
    return F.regexp_extract_all(F.lower(F.translate(text, "İ", "i")), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(text: Column, stop_words: list[str], max_ngram: int = 2) -> Column:
    """Unigrams and bigrams; stop words leave *before* bigrams are formed."""
    if max_ngram not in (1, 2):
        raise ValueError("max_ngram must be 1 or 2")
    words = tokens(text)
    if stop_words:
        words = F.filter(words, lambda t: ~t.isin(*stop_words))
    if max_ngram == 1:
        return words

    def with_pairs(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        heads, tails = F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs)
        return F.concat(w, F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b)))

    return let(words, with_pairs)


def joined(separator: str, *parts: Column) -> Column:
    """Join the parts that are present (not ``NULL``) with ``separator``."""
    return F.concat_ws(separator, *parts)


def present(text: Column) -> Column:
    """True when text is neither ``NULL`` nor empty."""
    return F.coalesce(text != "", F.lit(False))


def line(label: str, text: Column) -> Column:
    """``label`` followed by ``text`` when the text is present, else ``NULL``."""
    return F.when(present(text), F.concat(F.lit(label), text))


def two_decimals(x: Column) -> Column:
    """Two decimals, exact ties to even; ``NULL`` stays ``NULL``."""
    return F.call_function("format_number", x, F.lit("0.00"))
