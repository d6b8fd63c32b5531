"""PII: keyed surrogates for detected entities, with DataFrame functions only.

One pattern finds e-mail, IPv4 and IPv6 addresses, phone, card, social-security and account
(IBAN) numbers, secrets (hex digests and tokens with public prefixes) and titled names.  An
alternative can only start where a word starts, so a text is read about once.  Every distinct
entity (in canonical form: lower case, digits only, ...) gets a surrogate of its type from a
keyed digest: same shape, same script, same gender for names, valid check digits where the
card or account had them.  Names are replaced word by word, so that a surname stands for one
surrogate with and without a given name.  A surrogate that two entities share, or that is an
entity of the corpus itself, is drawn again with the next attempt, until all are distinct.
Since the mapping is by canonical form, an entity has one surrogate everywhere, written in
the format of each place.  Untitled names are not found, nor are IBANs with letters beyond
the bank code; two spellings of one IPv6 address count as two entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

# The forms that are looked for.
HOST = r"[\p{L}\p{N}\-]++"
EMAIL = rf"(?<![._%+\-\p{{L}}])[A-Za-z0-9._%+\-\p{{L}}]++@{HOST}(?:\.{HOST})+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
HEX = r"[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![:.])(?:(?:{HEX}:){{7}}{HEX}|(?:[0-9A-Fa-f]{{4}}|{HEX}(?::{HEX}){{1,5}})::(?:{HEX}(?::{HEX}){{0,4}})?)(?![0-9A-Za-z:])"
CARD = r"(?:\d{4}[ \-]?){3}\d{4}(?![\dA-Za-z])"
PHONE = r"\+\d{1,3}[ \-]?\(?\d{2,4}\)?[ \-]?\d{3}[ \-]?\d{4}(?!\d)"
LOCAL = r"(?<![\-./])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|0\d{2,4}[/\-]\d{3,4}[ \-]?\d{3,4})(?![\d\-])"
SSN = r"(?<![\-./])\d{3}-\d{2}-\d{4}(?![\d\-])"
IBAN = r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?\d{4}){2,6}(?: ?\d{1,3})?(?![0-9A-Za-z])"
SECRET = r"(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])"
TOKEN = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"
MALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Господин)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)"
NEUTRAL = r"(?:Dr|Dra|Prof|Доктор|Профессор)"
LEAD = rf"(?:(?:{MALE}|{FEMALE})\.? (?:{NEUTRAL}\.? )?|{NEUTRAL}\.? )"
WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
NAME = rf"(?<![\p{{L}}\p{{N}}]){LEAD}{WORD}(?: {WORD})?"
PATTERN = rf"(?<![A-Za-z0-9])(?:{'|'.join((EMAIL, IPV6, CARD, PHONE, LOCAL, SSN, IBAN, SECRET, TOKEN, NAME))})|{IPV4}"
TITLE = rf"^{LEAD}"
# Syllables of invented names, by script, and their ends by gender.
LATIN = ("ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "li", "no", "ka", "re")
CYRILLIC = ("ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ли", "но", "ка", "ре")
# Syllables end in a vowel, so a written name tells its stem.
ENDS = {"l": {"m": "n", "f": "na", "n": "s"}, "c": {"m": "н", "f": "на", "n": "с"}}
END = "(?:na|n|s|на|н|с)$"
LETTERS = {"l": "abcdefghijklmnopqrstuvwxyz", "c": "абвгдежзиклмнопрстуфхцчшыэюя"}
CYR = r"\p{IsCyrillic}"


#: The key of the query, where the session sets no ``spark.fluvius.pii.key``.
KEY = "release-1"


def kind_of(e: Column) -> Column:
    """The type of a place; ``name`` for titled names."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(TITLE), "name")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(e.contains(":"), "ipv6")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^(?:[0-9a-f]{40}|[0-9A-F]{40})$"), "secret")
        .when(e.rlike(r"^(?:AKIA|gh[pousr]_)"), "token")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^(?:\d{4}[ \-]?){3}\d{4}$"), "card")
        .otherwise("phone")
    )


def parts_of(place: Column) -> Column:
    """A place as an array of (lead, kind, gender, piece): the words of a name, or the place alone."""
    part = lambda lead, kind, gender, piece: F.struct(lead.alias("lead"), kind.alias("kind"), gender.alias("gender"), piece.alias("piece"))
    lead, none = F.regexp_extract(place, TITLE, 0), F.lit("")
    words = F.split(F.regexp_replace(place, TITLE, ""), " ")
    gender = F.when(lead.rlike(rf"^{FEMALE}[. ]"), "f").when(lead.rlike(rf"^{MALE}[. ]"), "m").otherwise("n")
    given, surname, last = F.lit("given"), F.lit("surname"), F.element_at(words, -1)
    two = F.array(part(lead, given, gender, F.get(words, F.lit(0))), part(F.lit(" "), surname, gender, last))
    named = F.when(F.size(words) == 2, two).otherwise(F.array(part(lead, surname, gender, last)))
    kind = kind_of(place)
    return F.when(kind == "name", named).otherwise(F.array(part(none, kind, none, place)))


def canonical(kind: Column, e: Column) -> Column:
    digits = F.regexp_replace(e, r"[^0-9]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind.isin("email", "ipv4", "ipv6", "secret"), F.lower(e)).otherwise(e)


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hex digest, going round."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column, f) -> Column:
    """f(character, place from 0) over a text, joined."""
    at = F.sequence(F.lit(0), F.length(text) - 1)
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(at, lambda i: f(F.substring(text, i + 1, F.lit(1)), i)), ""))


def _like(text: Column, digest: Column) -> Column:
    """Letters for letters of their script and case, digits for digits, all else as it is."""

    def one(c, i):
        b = _byte(digest, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(b, F.lit(len(letters))) + 1, F.lit(1))
        letter = F.when(c.rlike(CYR), pick(LETTERS["c"])).otherwise(pick(LETTERS["l"]))
        return F.when(c.rlike(r"\d"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return _chars(text, one)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit text, mod 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i, F.lit(2)) == 1, F.pmod(2 * d, F.lit(10)) + F.when(d >= 5, 1).otherwise(0)).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))


def _mod97(account: Column) -> Column:
    """An account in canonical form, its first four characters last, as a number mod 97 (1 if its check digits are right)."""
    turned = F.concat(F.substring(account, 5, 60), F.substring(account, 1, 4))

    def add(total, i):
        c = F.substring(turned, i + 1, F.lit(1))
        return F.pmod(F.when(c.rlike(r"\d"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(F.sequence(F.lit(0), F.length(turned) - 1), F.lit(0), add)


def surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity; of a name, the stem."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 512)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_like(local, digest), F.lit("@"), _like(host, F.sha2(F.concat(F.lit(key), domain), 512)), F.lit("."), top)
    ip = F.array_join(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.pmod(_byte(digest, k), F.lit(254)) + 1), ".")
    secret = F.substring(digest, 1, 40)
    phone = F.concat(F.substring(entity, 1, 1), F.substring(_like(entity, digest), 2, 40))
    body = F.substring(_like(entity, digest), 1, 15)
    card = F.concat(body, F.when(_luhn(entity) == 0, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")).otherwise(F.pmod(_byte(digest, F.lit(40)), F.lit(10)).cast("string")))

    hexed = _chars(entity, lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(F.pmod(_byte(digest, i), F.lit(16))))))
    country, bank = F.substring(entity, 1, 2), _like(F.substring(entity, 5, 60), digest)
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), bank))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod97(entity) == 1, check).otherwise(_like(F.substring(entity, 3, 2), F.reverse(digest))), bank)
    token = F.concat(F.substring(entity, 1, 4), _like(F.substring(entity, 5, 60), digest))

    def name(script, syllables):
        parts = F.array(*[F.lit(s) for s in syllables])
        one = lambda k: F.element_at(parts, F.pmod(_byte(digest, F.lit(k)), F.lit(16)) + 1)
        # Later attempts draw longer words, so that any number of names finds distinct ones.
        more = [F.when(attempt >= 2 * k, one(3 + k)).otherwise("") for k in range(1, 9)]
        return F.initcap(F.concat(*[one(k) for k in range(4)], *more))

    names = F.when(entity.rlike(CYR), name("c", CYRILLIC)).otherwise(name("l", LATIN))
    made = {"email": email, "ipv4": ip, "ipv6": hexed, "secret": secret, "token": token, "phone": phone, "ssn": _like(entity, digest), "iban": iban, "card": card}
    return F.coalesce(*[F.when(kind == k, v) for k, v in made.items()], names)


def written(kind: Column, gender: Column, place: Column, out: Column) -> Column:
    """A canonical surrogate in the format of one place: separators, case, the end for the gender."""
    ends = {k: F.coalesce(*[F.when(gender == g, F.lit(e)) for g, e in v.items()], F.lit("")) for k, v in ENDS.items()}
    named = F.concat(out, F.when(out.rlike(CYR), ends["c"]).otherwise(ends["l"]))
    ordinal = lambda i: F.length(F.regexp_replace(F.substring(place, F.lit(1), i + 1), r"[^0-9A-Z]", ""))
    spaced = _chars(place, lambda c, i: F.when(c.rlike(r"[0-9A-Z]"), F.substring(out, ordinal(i), F.lit(1))).otherwise(c))
    cased = _chars(out, lambda c, i: F.when(F.substring(place, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    # In hex a digit may stand where a capital was: the place's own case is that of all its letters.
    hexed = F.when(place.rlike("[A-F]"), F.upper(out)).otherwise(out)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind == "email", cased).when(kind.isin("secret", "ipv6"), hexed).when(kind.isin("given", "surname"), named).otherwise(out)


def mapping(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, entity -> surrogate: distinct within a kind and never an entity of the corpus."""
    stem = F.when(F.col("kind").isin("given", "surname"), F.regexp_replace("entity", END, "")).otherwise(F.col("entity"))
    known = entities.select(F.col("kind").alias("k_kind"), stem.alias("k_entity"))
    now = scratch.cut(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), key, F.lit(0))), "map-0")
    k = 0
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        shared = now.join(first, ["kind", "surrogate"]).filter(F.col("entity") != F.col("owner")).select("kind", "entity")
        real = now.join(known, (F.col("kind") == F.col("k_kind")) & (F.col("surrogate") == F.col("k_entity")), "left_semi").select("kind", "entity")
        again = scratch.cut(shared.unionByName(real).distinct().withColumnRenamed("kind", "a_kind").withColumnRenamed("entity", "a_entity"), f"again-{k}")
        if again.isEmpty():
            return now.select("kind", "entity", "surrogate")
        marked = now.join(again, (F.col("kind") == F.col("a_kind")) & (F.col("entity") == F.col("a_entity")), "left")
        attempt = F.col("attempt") + F.when(F.col("a_kind").isNotNull(), 1).otherwise(0)
        fresh = F.when(F.col("a_kind").isNotNull(), surrogate(F.col("kind"), F.col("entity"), key, F.col("attempt") + 1)).otherwise(F.col("surrogate"))
        k += 1
        now = scratch.cut(marked.select("kind", "entity", attempt.alias("attempt"), fresh.alias("surrogate")), f"map-{k}")
        scratch.drop(f"map-{k - 1}", f"again-{k - 1}")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (entities replaced), n_entities for every row.

    A null text stays null with no entities; an empty one stays empty.  Rows that repeat
    are replaced alike; a row with a null doc_id is treated like any other.  ``key`` is a
    secret of the caller: the same key gives the same surrogates.  An empty
    table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows are named by identifier and text, so that repeated identifiers do no harm.
    tag = F.xxhash64("doc_id", "text")
    found = F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1))
    places = rows.select("doc_id", tag.alias("tag"), F.posexplode(found).alias("pos", "place")).distinct()
    places = places.select("doc_id", "tag", "pos", F.posexplode(parts_of(F.col("place"))).alias("part", "p")).select("doc_id", "tag", "pos", "part", "p.*")
    places = scratch.cut(places.withColumn("entity", canonical(F.col("kind"), F.col("piece"))), "places")
    names = mapping(places.select("kind", "entity").distinct(), key, scratch)
    put = places.join(names, ["kind", "entity"]).select("doc_id", "tag", "pos", "part", F.concat("lead", written(F.col("kind"), F.col("gender"), F.col("piece"), F.col("surrogate"))).alias("w"))
    in_order = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "w"))), lambda x: x["w"])
    put = put.repartition("doc_id", "tag").groupBy("doc_id", "tag", "pos").agg(F.array_join(in_order("part"), "").alias("w"))
    put = put.groupBy("doc_id", "tag").agg(in_order("pos").alias("put"))
    put = scratch.cut(put.select(F.col("doc_id").alias("p_id"), F.col("tag").alias("p_tag"), "put"), "put")
    # Only texts with an entity move; the others go straight through.
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    joined = rows.filter(has).join(put, F.col("doc_id").eqNullSafe(F.col("p_id")) & (tag == F.col("p_tag")), "left")
    plain = rows.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    pieces = F.split("text", f"(?:{PATTERN})", -1)
    whole = F.concat(F.array_join(F.zip_with(pieces, "put", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    text = F.when(F.col("put").isNull(), F.col("text")).otherwise(whole)
    replaced = joined.select("doc_id", text.alias("text"), F.when(F.col("put").isNull(), 0).otherwise(F.size("put")).cast("long").alias("n_entities"))
    return replaced.unionByName(plain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.fluvius.pii.key", KEY))
    return out.select("doc_id", "n_entities", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"), F.when(F.col("n_entities") > 0, F.col("text")).alias("replaced_text"))
