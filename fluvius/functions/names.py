"""Names of waters as column expressions: abbreviations, spelling fixes, parts in parentheses.

Rules are small dictionaries that a caller brings; they become literals of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_name, name_key

LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


def _table(entries: dict[str, str]) -> Column:
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _found(entries: dict[str, str], word: Column) -> Column:
    return F.try_element_at(_table(entries), word)


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or r"(?!)"


def tokens(x: Column, abbreviations: dict[str, str]) -> Column:
    """Words by single spaces; a known abbreviation glued to what follows it is a word of its own."""
    known = _any(abbreviations)
    apart = F.regexp_replace(x, rf"(?iu)(?:(?<![^ ])|\G)({known})\.(?=[^ ])", "$1. ")
    return F.filter(F.split(apart, " "), lambda t: t != "")


def fix_word(word: Column, fixes: dict[str, str]) -> Column:
    """The word by the table of spellings; marks around it stay, and a word in capitals stays in capitals."""
    core = F.regexp_extract(word, r"^\P{L}*(\p{L}+)\P{L}*$", 1)
    fix = _found(fixes, F.lower(core))
    cased = F.when((F.length(core) > 1) & (core == F.upper(core)), F.upper(fix)).otherwise(fix)
    return F.when((core == "") | fix.isNull(), word).otherwise(F.replace(word, core, cased))


def expand_words(x: Column, abbreviations: dict[str, str], dotless: list[str] = (), fixes: dict[str, str] | None = None) -> Column:
    """A name with abbreviations written out ("A. Biguá", "A.Biguá"; those of ``dotless`` also without a dot) and spellings fixed."""
    bare = {k: abbreviations[k] for k in dotless}
    short = rf"^([{LETTERS}]{{1,4}})\."

    def one(t):
        dotted = F.lower(F.regexp_extract(t, short + "$", 1))
        spelled = F.when(t.rlike(short), t).otherwise(fix_word(t, fixes or {}))
        return F.coalesce(_found(abbreviations, dotted), _found(bare, F.lower(t)), spelled)

    return F.array_join(F.transform(tokens(x, abbreviations), one), " ")


def unexpanded(x: Column, abbreviations: dict[str, str]) -> Column:
    """Short dotted words that the table lacks, in order."""
    heads = F.transform(tokens(x, abbreviations), lambda t: F.regexp_extract(t, rf"^([{LETTERS}]{{1,4}})\.", 1))
    return F.transform(F.filter(heads, lambda h: (h != "") & _found(abbreviations, F.lower(h)).isNull()), lambda h: F.concat(h, F.lit(".")))


def main_name(x: Column) -> Column:
    """Without the parts in parentheses."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", " "), r"\s+", " "))


def other_names(x: Column) -> Column:
    """Names in parentheses, parted at "o" (or), those without letters and figures left out."""
    parts = F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), F.lit(1))
    plain = F.transform(parts, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"(?i)^o\s+", ""))
    return F.filter(F.transform(F.flatten(F.transform(plain, lambda p: F.split(p, r"(?i)\s+o\s+"))), F.trim), lambda p: name_key(p) != "")


def agency_name(x: Column, abbreviations: dict[str, str], leading: list[str], dotless: list[str] = (), fixes: dict[str, str] | None = None) -> Column:
    """An agency's name as a struct: raw, starred, display, others (names in parentheses), unexpanded, unbalanced.

    Empty and starred names have no display.  A type word that its own abbreviation repeats
    is kept once.  A name that begins with none of the ``leading`` words stops the query.
    """
    raw = clean_name(x)
    starred = F.coalesce(F.contains(raw, F.lit("*")), F.lit(False))
    main = main_name(raw)
    words = F.split(expand_words(main, abbreviations, dotless, fixes), " ")
    first, second = name_key(F.get(words, F.lit(0))), name_key(F.get(words, F.lit(1)))
    once = F.when((F.size(words) > 2) & (first == second), F.concat(F.slice(words, 1, 1), F.slice(words, 3, F.size(words)))).otherwise(words)
    known = name_key(F.get(once, F.lit(0))).isin([_plain_key(w) for w in leading])
    stop = F.raise_error(F.concat(F.lit("unknown first word: "), raw)).cast("string")
    usable = raw.isNotNull() & ~starred
    none = F.array().cast("array<string>")
    return F.struct(
        raw.alias("raw"),
        starred.alias("starred"),
        F.when(usable, F.when(known, F.array_join(once, " ")).otherwise(stop)).alias("display"),
        F.when(usable, F.transform(other_names(raw), lambda p: expand_words(p, abbreviations, dotless, fixes))).otherwise(none).alias("others"),
        F.when(usable, unexpanded(main, abbreviations)).otherwise(none).alias("unexpanded"),
        F.when(usable, main.rlike("[()]")).otherwise(False).alias("unbalanced"),
    )


def _plain_key(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def water_name(x: Column, abbreviations: dict[str, str], keep: list[str] = (), blank: str = "*") -> Column:
    """A water's name as a struct: name, blank, unknown, expanded.

    Dotted words are written out by the table, also where no space follows; those neither
    there nor in ``keep`` are listed as unknown and stay.
    """
    raw = clean_name(x)
    marked = F.coalesce(F.contains(raw, F.lit(blank)), F.lit(False))
    dotted = F.transform(F.regexp_extract_all(raw, F.lit(r"(\p{L}+)\.(?=\p{L}|\s|$)"), F.lit(1)), F.lower)
    known = F.array(*[F.lit(k) for k in abbreviations]).cast("array<string>")
    kept = F.array(*[F.lit(k.lower()) for k in keep]).cast("array<string>")
    name = raw
    for short, full in abbreviations.items():
        for follows, gap in ((r"(?=\p{L})", " "), (r"(?=\s|$)", "")):
            name = F.regexp_replace(name, rf"(?iu)(?<!\p{{L}}){re.escape(short)}\.{follows}", full + gap)
    usable, none = raw.isNotNull() & ~marked, F.array().cast("array<string>")
    return F.struct(
        F.when(usable, clean_name(name)).alias("name"),
        marked.alias("blank"),
        F.when(usable, F.array_sort(F.array_except(F.array_except(dotted, known), kept))).otherwise(none).alias("unknown"),
        F.when(usable, F.array_sort(F.array_intersect(dotted, known))).otherwise(none).alias("expanded"),
    )


def fix_name(x: Column, fixes: list[tuple[str, str, bool]]) -> Column:
    """A cleaned name after ordered fixes (from, to, whole word or else the whole name), and what was applied, as a struct.

    An empty name stops the query.
    """
    clean = F.coalesce(clean_name(x), F.raise_error(F.lit("empty name")).cast("string"))
    state = F.struct(clean.alias("name"), F.when(clean == x, F.array().cast("array<string>")).otherwise(F.array(F.lit("whitespace"))).alias("applied"))
    rules = [F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(word).alias("word"), F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{a}\E(?![\p{{L}}\p{{N}}])").alias("pattern")) for a, b, word in fixes]

    def step(s, r):
        after = F.when(r["word"], F.regexp_replace(s["name"], r["pattern"], F.replace(r["new"], F.lit("$"), F.lit("\\$")))).when(s["name"] == r["old"], r["new"]).otherwise(s["name"])
        done = F.when(after == s["name"], s["applied"]).otherwise(F.array_append(s["applied"], r["old"]))
        return F.struct(after.alias("name"), done.alias("applied"))

    return F.aggregate(F.array(*rules), state, step) if rules else state
