"""Text functions as column expressions: search form, slugs, keys, similarity, numbers in questions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters of all scripts with marks and their bare letters, by Unicode's canonical decomposition."""
    plain = [c for c in map(chr, range(0xC0, 0x10000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in plain]
    marks = lambda d: [unicodedata.category(x)[0] == "M" for x in d]
    pairs = [(c, d[0]) for c, d in pairs if d != c and ord(d[0]) < 0x10000 and not marks(d)[0] and all(marks(d)[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, BARE = _folds()


def strip_marks(x: Column) -> Column:
    """Letters without their marks, in every script; loose combining marks go too."""
    return F.regexp_replace(F.translate(x, MARKED, BARE), r"\p{M}+", "")


def normalize(x: Column) -> Column:
    """Search form: no marks, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(x)), r"\s+", " "))


def search_terms(names: Column) -> Column:
    """Distinct search forms of an array of names that are not empty, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), normalize), lambda t: t.isNotNull() & (t != "")))


def name_terms(names: Column) -> Column:
    """Search forms, each also without a generic first word (fixed values)."""
    full = search_terms(names)
    bare = F.transform(full, lambda t: F.regexp_replace(t, r"^(rio|arroyo|canada|canadon) ", ""))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.arrays_zip(full.alias("a"), bare.alias("b")), lambda p: F.array(p["a"], p["b"]))), lambda t: t != ""))


def name_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_marks(x)), r"[^a-z0-9°]+", " "))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_marks(x)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def clean_name(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def label(x: Column) -> Column:
    return F.coalesce(F.lower(clean_name(x)), F.lit("(none)"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def damaged(x: Column) -> Column:
    """Signs of a broken name: replacement characters, question marks, odd brackets or one between letters, capitals inside words."""
    count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return x.rlike("[�?]") | (count("(") != count(")")) | x.rlike(r"\p{Ll}\p{Lu}") | x.rlike(r"\p{L}\(\p{L}")


def drop_words(x: Column, words: list[str]) -> Column:
    """Without the given whole words; spaces put in order."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])", " "), r"\s+", " "))


def numbers_in(question: Column) -> Column:
    """Numbers that a question can mean: of digits in groups, the whole, a decimal point at each separator, and each group alone."""
    groups = F.transform(F.regexp_extract_all(question, F.lit(r"\d+(?:[ .,]\d+)*"), F.lit(0)), lambda g: F.split(g, "[ .,]"))
    point = lambda p, i: F.concat(F.array_join(F.slice(p, 1, i), ""), F.lit("."), F.array_join(F.slice(p, i + 1, F.size(p)), ""))
    places = lambda p: F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: i < F.size(p))
    forms = F.transform(groups, lambda p: F.concat(F.array(F.array_join(p, "")), F.transform(places(p), lambda i: point(p, i)), p))
    return F.array_distinct(F.transform(F.flatten(forms), lambda x: x.cast("double")))


def grounded(question: Column, number: Column) -> Column:
    """Whether a number is written in the question."""
    return F.array_contains(numbers_in(question), number.cast("double"))


def short_sha(x: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(x, 256), 1, length)
