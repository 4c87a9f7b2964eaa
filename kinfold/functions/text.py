"""Text normalisation as Column to Column functions."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import fixed

#: What stands on either side of a word boundary, with combining marks inside words.
INSIDE = "[\\p{L}\\p{M}\\p{N}_]"


def _form(name: str):
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(name, x), na_action="ignore")

    return F.pandas_udf(change, "string")


def nfkc(c: Column) -> Column:
    return _form("NFKC")(c)


def nfkd(c: Column) -> Column:
    return _form("NFKD")(c)


def table_of(mapping: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Split on single spaces, empty items dropped."""
    return F.filter(F.split(c, " ", -1), lambda x: x != "")


def map_tokens(array: Column, mapping: dict[str, str] | Column) -> Column:
    """Each token by a dictionary (or a map column); unknown tokens stay."""
    if isinstance(mapping, dict):
        if not mapping:
            return array
        mapping = table_of(mapping)
    return F.transform(array, lambda x: F.coalesce(F.try_element_at(mapping, x), x))


# --- classic: NFKC, accents kept ---------------------------------------------------------------


def classic_clean(c: Column, keep_marks: bool = False) -> Column:
    """NFKC, lower case, '&' as 'and', everything but letters, digits, '_' and space out.

    Combining marks are not letters, so Indic words fall apart at vowel signs unless ``keep_marks``.
    """
    kept = "\\p{L}\\p{N}_\\s" + ("\\p{M}" if keep_marks else "")
    e = F.replace(F.lower(nfkc(text_or_empty(c))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(e, f"(?U)[^{kept}]", " "), "(?U)\\s+", " "))


def classic_name(clean: Column) -> Column:
    """A cleaned name without legal forms; one of legal forms alone stays as it is."""
    left = F.filter(tokens(clean), lambda x: ~x.isin(fixed.LEGAL_SUFFIXES))
    return F.when(F.size(left) == 0, clean).otherwise(F.array_join(left, " "))


def classic_address(clean: Column) -> Column:
    return F.array_join(map_tokens(tokens(clean), fixed.CLASSIC_ADDRESS), " ")


def sorted_tokens(c: Column) -> Column:
    """The distinct tokens in order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(c))), " ")


def country_code(c: Column, table: dict[str, str] = fixed.COUNTRIES) -> Column:
    """Two-letter code of a country's name; unknown names come back in upper case."""
    up = F.upper(F.trim(text_or_empty(c)))
    return F.coalesce(F.try_element_at(table_of(table), up), up)


def acronym(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.substring(x, 1, 1)), "")


# --- accent-free: NFKD, Latin accents stripped -------------------------------------------------


def plain_decomposed(c: Column) -> Column:
    """``plain_clean`` of a text that is decomposed already."""
    e = F.lower(F.regexp_replace(c, "[̀-ͯ]", ""))
    e = F.regexp_replace(e, f"'s(?!{INSIDE})", "s")
    e = F.regexp_replace(e, "[^\\p{L}\\p{N}\\p{M}]+", " ")
    e = F.regexp_replace(e, f"(\\p{{Nd}})(st|nd|rd|th)(?!{INSIDE})", "$1")
    e = F.regexp_replace(e, f"(?<!{INSIDE})0+(\\p{{Nd}})", "$1")
    return F.trim(F.regexp_replace(e, "(?U)\\s+", " "))


def plain_clean(c: Column) -> Column:
    """'&' as 'and', Latin accents off, lower case, possessives, punctuation, ordinals, leading zeros; in this order."""
    return plain_decomposed(nfkd(F.replace(text_or_empty(c), F.lit("&"), F.lit(" and "))))


def plain_address(c: Column) -> Column:
    """``plain_clean`` with the names of states, wherever they stand, as tokens; longest names first."""
    e = plain_clean(c)
    both = list(fixed.US_STATES.items()) + list(fixed.INDIAN_STATES.items())
    for name, code in sorted(both, key=lambda x: -len(x[0])):
        e = F.regexp_replace(e, f"(?<!{INSIDE}){name}(?!{INSIDE})", f"_st_{code}")
    return e


def bigrams(array: Column) -> Column:
    """Neighbouring tokens joined by '_'; none of fewer than two."""
    n = F.size(array)
    return F.when(n >= 2, F.zip_with(F.slice(array, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(array, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def grams(c: Column, n: int = 4) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    k = F.length(c) - (n - 1)
    return F.when(k >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def state_of(joined: Column, country: Column) -> Column:
    """The state token that a whole address component names, by country, or null."""
    out = F.lit(None).cast("string")
    for name in ("US", "India", "France"):
        out = F.when(country == name, F.try_element_at(table_of(fixed.state_codes(name)), joined)).otherwise(out)
    return out


def address_tokens(cleaned: Column, country: Column, learnt: Column | None = None) -> Column:
    """Tokens of an address whose comma-separated, cleaned components come as an array.

    A component that names a state as a whole becomes the state's token; in others the mark of a state
    is taken off. ``learnt``: a map of native to Latin tokens, used for India.
    """

    def one(comp: Column) -> Column:
        own = tokens(comp)
        if learnt is not None:
            own = F.when(country == "India", map_tokens(own, learnt)).otherwise(own)
        whole = state_of(F.array_join(own, " "), country)
        kinds = F.array_distinct(own)
        native = F.when((F.size(kinds) == 1) & F.startswith(F.try_element_at(kinds, F.lit(1)), F.lit("_st_")), F.try_element_at(kinds, F.lit(1)))
        state = F.coalesce(whole, native)
        return F.when(state.isNotNull(), F.array(state)).otherwise(F.transform(own, lambda x: F.regexp_replace(x, "^_st_", "")))

    return F.flatten(F.transform(cleaned, one))
