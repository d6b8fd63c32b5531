"""Small rules as column expressions: validators, classes, identifiers, seeds, positions along a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, slugify

_U32 = 0xFFFFFFFF
#: Words that ask for a basin, and words around a name that mean nothing.
BASIN_WORDS = r"\b(sub ?cuencas?|cuencas?|sub ?basins?|basins?|watersheds?|catchments?)\b"
FILLER = r"\b(the|of|show|me|go|to|find|open|del?|la|el|los|las|mostrame|muestra|mostrar|ver|ir|al?)\b"
#: The layers of waters by precedence, and where each comes from.
TIERS = {"emb": 0, "nat": 1, "bh130": 2, "perenne": 3, "hydrolakes": 4}
ORIGINS = {"emb": "aprhi", "nat": "aprhi", "bh130": "ign", "perenne": "ign", "hydrolakes": "hydrolakes"}
#: Upper bounds of total phosphorus, in micrograms a litre.
TROPHIC = [(4, "ultraOligotrophic"), (10, "oligotrophic"), (35, "mesotrophic")]


def finite_at(doc: Column, path: str) -> Column:
    """The finite number at a dotted path of a JSON text, else null; numbers in quotes are texts."""
    at = F.try_variant_get(F.try_parse_json(doc), "$." + path, "variant")
    kind = F.schema_of_variant(at)
    x = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(F.try_parse_json(doc), "$." + path, "double"))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def matched(x: Column, pattern: str) -> Column:
    return F.when(x.rlike(pattern), x)


def river_id(x: Column) -> Column:
    return matched(x, r"\A[a-z0-9-]{1,64}\z")


def stream_id(x: Column) -> Column:
    return matched(x, r"\A[a-z0-9][a-z0-9-]{0,127}\z")


def reach_id(x: Column) -> Column:
    return matched(x, r"\A[1-9][0-9]{0,9}\z").cast("long")


def search_query(x: Column, most: int = 64) -> Column:
    """The search form, null where it is empty or the text longer than ``most``."""
    return F.when(F.length(x) <= most, F.nullif(normalize(x), F.lit("")))


def parse_question(x: Column, most: int = 120) -> Column:
    """A question as a struct: normalized, name (without basin and filling words), wants_basin; null where empty or too long."""
    plain = normalize(F.regexp_replace(x, r"[^\p{L}\p{N}\s-]", " "))
    name = F.regexp_replace(F.regexp_replace(plain, BASIN_WORDS, " "), FILLER, " ")
    out = F.struct(plain.alias("normalized"), F.trim(F.regexp_replace(name, r"\s+", " ")).alias("name"), plain.rlike(BASIN_WORDS).alias("wants_basin"))
    return F.when((F.length(x) <= most) & (plain != ""), out)


def map_status(label: Column, mapped: dict[str, str]) -> Column:
    """The status of a normalized label; that of an empty one is null, and an unknown one stops the query."""
    out = F.when(label == "(none)", F.lit(None).cast("string"))
    for k, v in mapped.items():
        out = out.when(label == k, F.lit(v))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown status: "), label)).cast("string"))


def detail_verdict(far: Column, source: Column, base: Column, least_of_source: float, least_of_base: float) -> Column:
    """Shares (percent) of a candidate's far length in its source and in the baseline, and whether both suffice.

    Thresholds are held against unrounded shares; a share without a denominator never passes.
    """
    share = lambda of: F.when(~F.isnan(far) & ~F.isnan(of) & (of > 0), far / of * 100)
    extra, adds = share(source), share(base)
    real = F.coalesce((extra >= least_of_source) & (adds >= least_of_base), F.lit(False))
    return F.struct(F.round(far, 1).alias("extra_km"), F.round(extra, 1).alias("of_source"), F.round(adds, 1).alias("over_base"), real.alias("real"))


def band_width_m(hectares: Column, km: Column) -> Column:
    return F.when((hectares > 0) & (km > 0), hectares * 10_000 / (km * 1000))


def trophic_class(tp: Column) -> Column:
    out = F.when(tp.isNull(), F.lit(None).cast("string"))
    for at, name in TROPHIC:
        out = out.when(tp < at, name)
    return out.when(tp <= 100, "eutrophic").otherwise("hypereutrophic")


def looked_up(key: Column, table: dict, what: str) -> Column:
    """The entry of a key; a key that the table lacks stops the query unless the table has "*"."""
    out = None
    for k, v in table.items():
        if k != "*":
            out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    rest = F.lit(table["*"]) if "*" in table else F.raise_error(F.concat(F.lit(f"no {what} for "), key.cast("string")))
    return rest if out is None else out.otherwise(rest)


def piece_order(strahler: Column, source: Column, cls: Column, table: dict[str, int]) -> Column:
    """The stream order of a piece, else the table's order for "source:class"."""
    return F.coalesce(strahler, looked_up(F.concat_ws(":", source, cls), table, "order"))


def flow_code(kind: Column) -> Column:
    return F.when(kind == "perennial", 0).when(kind.isNotNull(), 1)


def water_origin(layer: Column) -> Column:
    return looked_up(layer, ORIGINS, "origin")


def water_tier(layer: Column) -> Column:
    return looked_up(layer, TIERS, "tier")


def water_kind(layer: Column, lake_type: Column) -> Column:
    lake = layer == "hydrolakes"
    return F.when(layer.isin("emb", "bh130") | (lake & (lake_type == 2)), "reservoir").when(lake & (lake_type == 3), "controlled-lake").otherwise("lake")


def water_id(layer: Column, source_id: Column) -> Column:
    """Origin, layer and the source's number; one that is no number stops the query."""
    number = F.when(source_id.rlike(r"\A[0-9]+\z"), source_id).otherwise(F.raise_error(F.concat(F.lit("no number: "), source_id)).cast("string"))
    return F.when(layer == "hydrolakes", F.concat(F.lit("hydrolakes-"), number)).otherwise(F.concat_ws("-", water_origin(layer), layer, number))


def river_slug(slug: Column, short_name: Column) -> Column:
    return F.coalesce(slug, slugify(short_name))


def named_id(key: Column, mouth: Column) -> Column:
    return F.concat_ws("-", slugify(key), mouth.cast("string"))


def section_id(slug: Column, index: Column) -> Column:
    digits = index.cast("string")
    return F.concat_ws("-", slug, F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def natural_key(x: Column, width: int = 20) -> Column:
    """Sorts figures inside texts by their value: runs of digits are padded to ``width``, the rest is in lower case."""
    runs = F.regexp_extract_all(x, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    pad = lambda r: F.lpad(F.regexp_replace(r, "^0+(?=[0-9])", ""), width, "0")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), pad(r)).otherwise(F.lower(r))), "")


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers, its low 32 bits; no step leaves 64 bits."""
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_U32))


def text_seed(x: Column) -> Column:
    """FNV-1a of the UTF-16 units of a text, as an unsigned 32-bit number."""
    hexed = F.hex(F.encode(x, "UTF-16BE"))
    places = F.filter(F.sequence(F.lit(0), F.length(x) * 2), lambda i: i * 4 < F.length(hexed))
    units = F.transform(places, lambda i: F.conv(F.substr(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: _times(h.bitwiseXOR(u), F.lit(16777619).cast("long")))


def seeded_unit(seed: Column) -> Column:
    """First number in [0, 1) of the mulberry32 generator with an unsigned 32-bit seed."""
    a = (seed.cast("long") + 0x6D2B79F5).bitwiseAND(F.lit(_U32))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_U32)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def station_positions(s0: Column, s1: Column, spacing: float, total: Column, pad: int) -> Column:
    """Positions from s0 to s1, both included, and up to ``pad`` more on each side inside [0, total], as a struct: s, first, last (exclusive)."""
    whole = F.greatest(F.ceil((s1 - 1e-6 - s0) / spacing) - 1, F.lit(0)).cast("int")
    steps = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k > 0)
    inner = F.concat(F.array(s0), F.transform(steps(whole), lambda k: s0 + k * spacing), F.array(s1))
    before = F.transform(F.filter(F.reverse(steps(F.lit(pad))), lambda k: s0 - k * spacing >= 0), lambda k: s0 - k * spacing)
    after = F.transform(F.filter(steps(F.lit(pad)), lambda k: s1 + k * spacing <= total), lambda k: s1 + k * spacing)
    return F.struct(F.concat(before, inner, after).alias("s"), F.size(before).alias("first"), (F.size(before) + F.size(inner)).alias("last"))


def line_wkt(x: Column) -> Column:
    """Points (x, y) of a LINESTRING text; anything else stops the query."""
    body = F.regexp_extract(F.trim(x), r"(?is)^LINESTRING\s*\((.*)\)$", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    bad = (body == "") | F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    return F.when(x.isNull(), None).when(bad, F.raise_error(F.concat(F.lit("no line: "), F.substring(x, 1, 40))).cast("array<struct<x:double,y:double>>")).otherwise(points)


def segment_at(cumulative: Column, s: Column) -> Column:
    """Index of the segment of a line that holds position s, from its cumulative lengths; ends hold what lies beyond."""
    under = F.size(F.filter(cumulative, lambda c: c <= s)) - 1
    return F.greatest(F.lit(0), F.least(under, F.size(cumulative) - 2))
