"""Text expressions: words, token estimates, language, snippets, trigrams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_estimate(text: Column, language: Column) -> Column:
    """Words times 2.3 for Korean, times 1.3 otherwise, rounded down."""
    n = F.size(words(text))
    return F.floor(n * F.when(language == "ko", F.lit(2.3)).otherwise(F.lit(1.3))).cast("int")


def language(text: Column) -> Column:
    """``ko`` if Hangul are over half of the Hangul and Latin letters or there are none of both, ``en`` under a tenth, else ``mixed``."""
    # what replacing leaves is measured: a count of matches makes a string of each letter
    ko = F.length(text) - F.length(F.regexp_replace(text, "[가-힯]+", ""))
    both = F.length(text) - F.length(F.regexp_replace(text, "[a-zA-Z가-힯]+", ""))
    return once(F.struct(ko.alias("ko"), both.alias("both")), lambda n: _language(n["ko"], n["both"]))


def _language(ko: Column, both: Column) -> Column:
    ratio = ko / F.nullif(both, F.lit(0))
    return F.when(F.coalesce(both, F.lit(0)) == 0, "ko").when(ratio > 0.5, "ko").when(ratio < 0.1, "en").otherwise("mixed")


def snippet(text: Column, size: int = 300) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def counted(terms: Column) -> Column:
    """(term, tf) of each distinct term of an array, in order."""
    return _runs(F.sort_array(terms), lambda x: x, lambda all_, begin, n: F.struct(F.get(all_, begin).alias("term"), n.cast("long").alias("tf")))


def placed(terms: Column) -> Column:
    """(term, tf, positions) of each distinct term of an array, in order: the places, from 0, at which it stands."""
    pairs = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("place"))))
    places = lambda all_, begin, n: F.transform(F.slice(all_, begin + 1, n), lambda p: p["place"])
    return _runs(pairs, lambda x: x["term"], lambda all_, begin, n: F.struct(F.get(all_, begin)["term"].alias("term"), n.cast("long").alias("tf"), places(all_, begin, n).alias("positions")))


def _runs(ordered: Column, name: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(ordered, begin, size)`` of each run of elements of one ``name``."""

    def of(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i < F.size(x)) & ((i == 0) | (name(F.get(x, i)) != name(F.get(x, i - 1)))))
        return once(begins, lambda b: F.transform(b, lambda begin, j: make(x, begin, F.coalesce(F.get(b, j + 1), F.size(x)) - begin)))

    return once(ordered, of)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-case word with two blanks before and one behind."""
    grams = F.transform(terms(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def search_text(prefix: Column, section: Column, text: Column) -> Column:
    """The context prefix, or the section in brackets where there is none, before the text."""
    return F.concat(F.coalesce(F.nullif(prefix, F.lit("")), F.concat(F.lit("["), section, F.lit("]"))), F.lit(" "), text)


def mention_free(text: Column) -> Column:
    """A chat message without its mentions."""
    return F.trim(F.regexp_replace(text, "<@[A-Z0-9]+>", ""))
