"""Name and class rules on small cases with known results."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluvius.functions import names as N
from fluvius.functions import rules as R
from fluvius.operators import graph, naming
from fluvius.plans.rules import SHORT

LEADING = ["Arroyo", "Río", "Cañada", "Quebrada", "Brazo", "Laguna"]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).head().y


def test_agency_names(spark):
    read = lambda x: one(spark, lambda c: N.agency_name(c, SHORT, LEADING, ["cda"], {"rio": "Río", "biguá": "Biguá"}), x)
    assert read("A. Biguá").display == "Arroyo Biguá"
    assert read("Brazo R. Carnero").display == "Brazo Río Carnero"
    assert read("A.Q.del Rodeo").display == "Arroyo Quebrada del Rodeo"
    assert read("A. Cda de los Duendes (Seco)").others == ["Seco"]
    assert read("R. Junta (A. Santa Cruz)").others == ["Arroyo Santa Cruz"]
    assert read("A. La Totorilla (o Suyataco o Alto)").others == ["Suyataco", "Alto"]
    assert read("A. Arroyo 630").display == "Arroyo 630"
    assert read("RIO Seco").display == "RÍO Seco"
    assert read("A. Sta. Rosa").unexpanded == ["Sta."]
    assert read("A. Roto (sin").unbalanced
    assert read(" ").display is None and read(None).raw is None
    starred = read("*A. Nada")
    assert starred.starred and starred.display is None
    with pytest.raises(PySparkException):
        read("Zanja Honda")


def test_water_names(spark):
    table = {"lag": "Laguna", "lags": "Lagunas", "cda": "Cañada"}
    read = lambda x: one(spark, lambda c: N.water_name(c, table, ["ing", "a", "m"]), x)
    assert read("Lag.La Chanchera").name == "Laguna La Chanchera"
    assert read("  Lag.  De La Legua ").name == "Laguna De La Legua"
    assert read("Lags. Las Viscacheras").name == "Lagunas Las Viscacheras"
    kept = read("Ing. A. M. Allende (La Viña)")
    assert kept.name == "Ing. A. M. Allende (La Viña)" and kept.unknown == []
    strange = read("Emb. Nuevo")
    assert strange.name == "Emb. Nuevo" and strange.unknown == ["emb"] and strange.expanded == []
    assert read("* Lag. X").blank and read(None).name is None


def test_name_fixes(spark):
    fixes = [("Río Carcaraña", "Río Carcarañá", False), ("Rio", "Río", True)]
    read = lambda x: one(spark, lambda c: N.fix_name(c, fixes), x)
    assert tuple(read("Río Carcaraña")) == ("Río Carcarañá", ["Río Carcaraña"])
    assert read("Rio Juramento Riosal").name == "Río Juramento Riosal"
    assert tuple(read("Río Seco  - Cuenca Alta")) == ("Río Seco - Cuenca Alta", ["whitespace"])
    assert read("Río Carcarañá").applied == []
    with pytest.raises(PySparkException):
        read(" ")


def test_seeds(spark):
    def fnv(text):
        h = 0x811C9DC5
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return h

    def first(seed):
        a = (seed + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 2**32

    texts = ["", "limay-010", "Río", "a\U0001f30a", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", R.text_seed(F.col("x")).alias("s")).withColumn("u", R.seeded_unit(F.col("s"))).collect()
    assert [(r.s, r.u) for r in rows] == [(fnv(t), first(fnv(t))) for t in texts]


def test_small_rules(spark):
    assert one(spark, lambda c: R.detail_verdict(c, F.lit(0.0), F.lit(10.0), 1, 1), 5.0, "double").real is False
    assert [one(spark, lambda c: R.natural_key(c) < R.natural_key(F.lit("a10")), x) for x in ("A2", "A010", "b1")] == [True, False, False]
    assert one(spark, lambda c: R.finite_at(c, "a.b"), '{"a": {"b": 2.5}}') == 2.5
    assert one(spark, lambda c: R.finite_at(c, "a.b"), '{"a": {"b": "2.5"}}') is None
    assert one(spark, lambda c: R.finite_at(c, "a"), "no json") is None
    assert one(spark, lambda c: R.section_id(c, F.lit(12345)), "limay") == "limay-12345"
    asked = one(spark, R.parse_question, "Mostrame la subcuenca del Neuquén")
    assert asked.name == "neuquen" and asked.wants_basin
    assert one(spark, R.parse_question, "¿?") is None and one(spark, R.parse_question, "a" * 121) is None
    at = one(spark, lambda c: R.station_positions(c, F.lit(100.0), 50.0, F.lit(160.0), 2), 0.0, "double")
    assert (at.s, at["first"], at["last"]) == ([0.0, 50.0, 100.0, 150.0], 0, 3)
    assert [tuple(p) for p in one(spark, R.line_wkt, " linestring(1 2, 3.5 -4)")] == [(1.0, 2.0), (3.5, -4.0)]
    for expr, bad in ((R.line_wkt, "POINT (1 2)"), (lambda c: R.map_status(c, {"a": "b"}), "z"), (lambda c: R.water_id(F.lit("nat"), c), "7a"), (R.water_tier, "sea")):
        with pytest.raises(PySparkException):
            one(spark, expr, bad)


def test_corrections(spark):
    rows = [("Río Anisacate", "Río Anizacate", 0.8), ("Río Anisacate", "Río Anisacata", 0.8), ("Arroyo Seco", "Arroyo Seca", 0.9), ("Arroyo Seco", "ARROYO SECO", 0.6), ("Río Uno", "Río Una", 0.9), ("Río Alto", "Río Alta", 0.2), ("Río Bajo", "Bajo", 0.9)]
    used = [(x,) for x in ("Río Anisacate", "Arroyo Seco", "Río Uno", "Río Una", "Río Alto", "Río Bajo")]
    out = naming.corrections(spark.createDataFrame(rows, "display string, name string, share double"), spark.createDataFrame(used, "display string")).collect()
    assert [tuple(r) for r in out] == [("Río Anisacate", "Río Anisacata", 0.8, 1)]


def test_selection(spark):
    rows = [(f"{r}-{k}", r, k) for r in "ab" for k in range(1, 6)]
    t = spark.createDataFrame(rows, "id string, river string, place int")
    pick = lambda *a: sorted(r.id for r in naming.select_ids(t, *a).collect())
    assert len(pick()) == 10
    assert pick("a-1, a-3..a-5") == ["a-1", "a-3", "a-4", "a-5"]
    assert pick("a-1", "b") == ["a-1", "b-1", "b-2", "b-3", "b-4", "b-5"]
    for bad in (("a-9",), ("a-1..b-2",), ("a-3..a-1",), ("", "c")):
        with pytest.raises(ValueError):
            pick(*bad)


def test_hierarchy(spark):
    t = spark.createDataFrame([("b", None, 0, 1), ("b-a", "b", 1, 2), ("b-z", "b", 1, 3), ("b-a-k", "b-a", 2, 4), ("a", None, 0, 5)], "id string, parent string, level int, place int")
    assert [(r.id, r.depth) for r in naming.depth_first(t).collect()] == [("a", 0), ("b", 0), ("b-a", 1), ("b-a-k", 2), ("b-z", 1)]
    assert naming.hierarchy_problems(t).isEmpty()
    bad = spark.createDataFrame([("a", None, 1, 1), ("c", "b", 1, 2), ("b", "a", 2, 3), ("d", "b", 2, 4), ("d", "b", 3, 5)], "id string, parent string, level int, place int")
    assert sorted((r.id, r.problem[:6]) for r in naming.hierarchy_problems(bad).collect()) == [("a", "root m"), ("c", "parent"), ("d", "duplic"), ("d", "level ")]
    with pytest.raises(ValueError):
        naming.ancestor_paths(spark.createDataFrame([("a", "q")], "id string, parent string"))
    with pytest.raises(graph.CycleError):
        naming.ancestor_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")).collect()
