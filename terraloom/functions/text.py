"""Names, codes and phone numbers as Column expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters with a stroke and ligatures keep their base form here; accent stripping alone is not uniform on them.
_FOLD = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l"))


def strip_accents(c: Column) -> Column:
    """Decomposes and drops combining marks, by the commons library that ships with Spark."""
    return F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), c)


def name_key(c: Column) -> Column:
    """Lower case, no accents, letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", "")


def accented_key(c: Column) -> Column:
    """Like :func:`name_key` with accents kept."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def ascii_key(c: Column) -> Column:
    """ASCII words parted by one space."""
    folded = F.lower(strip_accents(F.lower(c)))
    for a, b in _FOLD:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def aliased_key(c: Column, aliases: dict[str, str]) -> Column:
    """:func:`accented_key`, then a table of equal names."""
    key = accented_key(c)
    if not aliases:
        return key
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


def upper_key(c: Column) -> Column:
    """Upper-case ASCII without what stands in parentheses and with common character references resolved."""
    said = c
    for a, b in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
        said = F.replace(said, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.regexp_replace(said, r"\([^)]*\)", " "))), r"[^A-Z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(ascii_key(c), " "), lambda t: t != "")


def token_forms(c: Column, stop: list[str], generic: list[str]) -> dict[str, Column]:
    """Forms for matching, from loose to bare: ``loose`` all words, ``core`` without stop words, ``significant`` also without generic ones, ``compact`` core run together, ``skeleton`` compact without vowels."""
    words = tokens(c)
    core = F.filter(words, lambda t: ~t.isin(stop)) if stop else words
    bare = F.filter(core, lambda t: ~t.isin(generic)) if generic else core
    compact = F.array_join(core, "")
    return {
        "loose": F.array_join(words, " "),
        "core": F.array_join(core, " "),
        "significant": F.array_join(F.array_sort(F.array_distinct(bare)), " "),
        "compact": compact,
        "skeleton": F.regexp_replace(compact, "[aeiou]", ""),
    }


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of distinct words in common; 0 where both are empty."""
    return words_jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def words_jaccard(x: Column, y: Column) -> Column:
    """:func:`token_jaccard` of the distinct tokens, for pairs whose sides were split before they met."""
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def numbers_conflict(a: Column, b: Column) -> Column:
    """Both names have number words and these differ."""
    x, y = (F.array_sort(F.filter(tokens(c), lambda t: t.rlike(r"^\d+$"))) for c in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one edit; the lengths are compared first."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 1, F.lit(False)).otherwise(F.levenshtein(a, b, 1) >= 0)


def spaced_key(c: Column) -> Column:
    """Like :func:`name_key`, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", " "))


def same_name(a: Column, b: Column) -> Column:
    """Equal keys, with or without a last word city."""
    bare = lambda c: F.regexp_replace(spaced_key(c), r"\s+city$", "")
    return bare(a) == bare(b)


@functools.cache
def _marked() -> dict[int, str]:
    """Letters by the number of marks that they decompose into."""
    out: dict[int, str] = {}
    for c in map(chr, range(0x80, 0x3100)):
        n = sum(unicodedata.combining(x) > 0 for x in unicodedata.normalize("NFD", c))
        if n and unicodedata.category(c)[0] == "L":
            out[n] = out.get(n, "") + c
    return out


def accents(c: Column) -> Column:
    """Marks of the decomposed form, so that composed and decomposed spellings count alike."""
    counts = [F.regexp_count(c, F.lit(f"[{letters}]")) * n for n, letters in _marked().items()]
    return sum(counts, F.regexp_count(c, F.lit(r"\p{M}")))


def preferred_spelling(native: Column, other: Column) -> Column:
    """Of two equal names the one to show: the native one where they differ by a last word city alone, else the one with more accents, the native one on ties; dashes become spaces."""
    city = (spaced_key(native) != spaced_key(other)) & same_name(native, other)
    best = F.when(~city & (accents(other) > accents(native)), other).otherwise(native)
    return F.regexp_replace(F.trim(F.regexp_replace(best, r"\s*[-\u2010-\u2014]\s*", " ")), r"\s+", " ")


def is_latin(c: Column) -> Column:
    """Has letters, all of them Latin."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def in_block(c: Column, block: str) -> Column:
    """Has a character of a Unicode block, such as Tibetan or Khmer."""
    return c.rlike(r"\p{In%s}" % block)


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def match_ratio(a: Column, b: Column) -> Column:
    """Gestalt similarity: twice the matched characters of longest common blocks over all characters. No built-in has it, so use it on blocked pairs only."""
    return _ratio(a, b)


def fuzzy_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0.9 of the best ratio among the forms and 0.1 of the word Jaccard of the loose ones."""
    best = F.greatest(*[match_ratio(a[k], b[k]) for k in a])
    return F.lit(0.9) * best + F.lit(0.1) * token_jaccard(a["loose"], b["loose"])


def range_codes(c: Column) -> Column:
    """Two-digit codes of a label: ``30-34`` that range, ``27`` itself, ``27x`` and ``279`` their first two digits, ``0x`` ten without ``00``;
    any other label is an error."""
    label = F.lower(F.trim(c))
    low, high = (F.regexp_extract(label, r"^(\d{2})\s*-\s*(\d{2})$", k).cast("int") for k in (1, 2))
    ten = F.regexp_extract(label, r"^(\d)x$", 1).cast("int") * 10
    two = lambda first, last: F.transform(F.sequence(first, last), lambda n: F.lpad(n.cast("string"), 2, "0"))
    return (
        F.when(label.rlike(r"^\d{2}\s*-\s*\d{2}$") & (low <= high), two(F.coalesce(low, F.lit(0)), F.greatest(F.coalesce(high, F.lit(0)), F.coalesce(low, F.lit(0)))))
        .when(label.rlike(r"^\d{2}[\dx]?$"), F.array(F.substring(label, 1, 2)))
        .when(label.rlike(r"^\dx$"), F.filter(two(F.coalesce(ten, F.lit(0)), F.coalesce(ten, F.lit(0)) + 9), lambda s: s != "00"))
        .otherwise(F.raise_error(F.concat(F.lit("no postal label: "), F.coalesce(c, F.lit("null")))).cast("array<string>"))
    )


def split_phones(c: Column) -> Column:
    """Numbers of a field that lists several."""
    return F.filter(F.transform(F.split(c, "[;/|]"), lambda p: F.trim(p)), lambda p: p != "")


def national_number(c: Column, country: str) -> Column:
    """Digits from the trunk 0 on, without an extension; 00cc and cc become 0, and a number without a 0 is null."""
    digits = F.regexp_replace(F.regexp_replace(c, r"(?is)\b(?:ext|extension|x)\b.*$", ""), r"[^0-9]", "")
    own = F.when(digits.startswith("00" + country), F.concat(F.lit("0"), F.substring(digits, 3 + len(country), 100)))
    own = own.when(digits.startswith(country), F.concat(F.lit("0"), F.substring(digits, 1 + len(country), 100))).otherwise(digits)
    return F.when(own.startswith("0"), own)


def area_code(c: Column, country: str, known: list[str]) -> Column:
    """The code of the known ones (all of one length) that a national number starts with, else null."""
    code = F.substring(national_number(c, country), 1, len(known[0]))
    return F.when(code.isin(known), code)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def significant_digits(c: Column) -> Column:
    """Without leading zeros; the string 0 stays."""
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def calling_code(c: Column) -> Column:
    return F.when(F.trim(c) == "", F.lit(None)).when(F.trim(c).startswith("+"), F.trim(c)).otherwise(F.concat(F.lit("+"), F.trim(c)))


def fixed_code(c: Column, width: int) -> Column:
    """A code as text with its leading zeros, also where it was read as a number such as 11.0."""
    return F.lpad(F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", ""), width, "0")


def display_name(native: Column, display: Column, answer: Column) -> Column:
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(native), filled(display), answer)


def stable_unit(c: Column, most: float = 0.18) -> Column:
    """A stable number in [0, most) from a string: hash = hash * 31 + code, modulo 2 ** 32; its last three digits count."""
    code = F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(1 << 32)))
    return code % 1000 / F.lit(1000.0) * most


def array_id(codes: Column) -> Column:
    """One id for a set of codes, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(codes)), "-")


def candidate_code(*candidates: Column, missing: str = "-99", valid: list[str] | None = None) -> Column:
    """The first candidate that is neither blank nor ``missing`` and, if given, among the valid ones."""
    good = lambda c: (F.trim(c) != "") & (c != missing) & (c.isin(valid) if valid else F.lit(True))
    return F.coalesce(*[F.when(good(c), c) for c in candidates])


def resolved_language(country: Column, names: Column, overrides: dict[str, str | None]) -> Column:
    """Of ``names`` (array of structs language, name, in the order of the source) the language whose name to show, or null.

    An override decides, also one by null; it must be among the languages. Else the first language, if there is one alone or all names that are not blank are equal by key; else an error.
    """
    languages = F.transform(names, lambda n: n["language"])
    keys = F.array_distinct(F.transform(F.filter(names, lambda n: F.coalesce(n["name"], F.lit("")) != ""), lambda n: name_key(n["name"])))
    fail = lambda said: F.raise_error(F.concat(country, F.lit(said))).cast("string")
    found = F.when((F.size(names) <= 1) | (F.size(keys) <= 1), F.try_element_at(languages, F.lit(1))).otherwise(fail(" has different names and no override"))
    if not overrides:
        return found
    table = F.create_map(*[F.lit(x) if x is not None else F.lit(None).cast("string") for pair in overrides.items() for x in pair])
    chosen = F.try_element_at(table, country)
    given = F.when(chosen.isNull() | F.array_contains(languages, chosen), chosen).otherwise(fail(" has an override that is none of its languages"))
    return F.when(country.isin(list(overrides)), given).otherwise(found)


def two_lines(first: Column, second: Column) -> Column:
    """Label of two lines; one where the second is blank or equal."""
    return F.when(F.coalesce(F.trim(second), F.lit("")).isin("") | (first == second), first).otherwise(F.concat_ws("\n", first, second))
