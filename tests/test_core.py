import math
import random

import pytest
from pyspark.sql import functions as F

PLANTS = "row_id bigint, source_name string, name string, fueltype string, technology string, set_type string, country string, capacity double, lat double, lon double, datein double, projectid string, eic string"


def test_missing_rules(spark):
    from regfuse.functions.missing import capacity_missing, lat_missing, lon_missing, text_missing, year_missing

    rows = [(0.0, 0.0, 0.0, -1.0, " "), (51.3, 0.0, 1900.0, 5.0, "Wind"), (float("nan"), 9.0, 9999.0, 999999.0, "TBD"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, y double, c double, f string")
    out = df.select(lat_missing(), lon_missing(), year_missing("y"), capacity_missing("c"), text_missing("f")).collect()
    assert [tuple(r) for r in out] == [(True,) * 5, (False,) * 5, (True, False, True, True, True), (True,) * 5]


def test_segmenter_protects_known_values_and_quotes():
    from regfuse.operators.packed import Segmenter

    seg = Segmenter(["XX XXXXX XXXXX", "XX/unit/XXXX", "XX-XXXX"])
    cut = lambda t: [t[a:b] for a, b in seg.spans(t)]
    assert cut("XX XXXXX XXXXX, XX XXXXX XXXXX") == ["XX XXXXX XXXXX"] * 2
    assert cut("XX/unit/XXXX / XX/unit/XXXX und XX/unit/XXXX") == ["XX/unit/XXXX"] * 3
    assert cut('XX-XXXX; "XX-XXXX; rev X" ;') == ["XX-XXXX", "XX-XXXX; rev X"]
    assert cut("['XX-XXXX', 'XX-XXXX, old']") == ["XX-XXXX", "XX-XXXX, old"]
    assert cut(",XX-XXXX, ,XX-XXXX") == ["XX-XXXX"] * 2
    assert cut(" ;; ") == [] and cut("") == []


def test_split_packed_edges(spark):
    from regfuse.operators.packed import split_packed

    df = spark.createDataFrame([(1, "AB-1234, AB-5678", "x"), (2, "AB-1111", "x"), (3, None, "x"), (4, " ", "x"), (5, "AB-2222", "x"), (1, "AB-1234; AB-1234", "x")], "row_id bigint, f string, pos string")
    out = sorted(map(tuple, split_packed(df, "row_id", ["f"]).collect()))
    assert out == sorted([(1, "f", 1, "AB-1234"), (1, "f", 2, "AB-5678"), (1, "f", 1, "AB-1234"), (1, "f", 2, "AB-1234"), (2, "f", 1, "AB-1111"), (5, "f", 1, "AB-2222")])
    assert split_packed(df.limit(0), "row_id", ["f"]).count() == 0


def test_points_near_equals_brute_force(spark):
    from regfuse.operators.spatial import points_near

    rnd = random.Random(1)
    p = [(i, rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for i in range(300)] + [(900, 89.99, 10.0), (901, 10.0, 179.99), (902, None, 1.0), (903, float("nan"), 1.0)]
    c = [(i, x + rnd.uniform(-180, 180) * (i % 2), min(90.0, max(-90.0, y + rnd.uniform(-1, 1)))) for i, y, x in p[:150]] + [(800, -170.0, 89.995), (801, -179.99, 10.0), (802, None, 2.0)]
    left = spark.createDataFrame(p, "row_id bigint, lat double, lon double")
    right = spark.createDataFrame([(i, ((x + 180) % 360 - 180) if x is not None else None, y) for i, x, y in c], "bus bigint, x double, y double")

    def km(a, b, u, v):
        s = math.sin(math.radians(u - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(u)) * math.sin(math.radians(v - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(s)))

    got = {(r.row_id, r.bus) for r in points_near(left, right, 200.0).collect()}
    want = {(i, r.bus) for i, la, lo in p if la is not None and la == la for r in right.collect() if r.x is not None and km(la, lo, r.y, r.x) <= 200}
    assert got == want and (900, 800) in got and (901, 801) in got
    assert points_near(left.limit(0), right, 5.0).count() == 0


def test_points_in_regions(spark):
    from regfuse.operators.spatial import points_in_regions

    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    regions = spark.createDataFrame([("A", ring), ("B", None)], "region string, ring array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 5.0), (3, None, 5.0)], "row_id bigint, lat double, lon double")
    assert [tuple(r) for r in points_in_regions(points, regions).collect()] == [(1, "A")]


def test_filled_values_are_marked_and_near(spark):
    from regfuse.operators.impute import fill_plants

    rnd = random.Random(3)
    rows = []
    for i in range(400):
        cc, la, lo = [("Germany", 51.0, 10.0), ("Spain", 40.0, -4.0)][i % 2]
        fuel, year = [("Wind", 2015.0), ("Hydro", 1950.0)][i // 2 % 2]
        lost = i >= 380
        rows.append((i, "S", f"Place{i} Stadt{i}", None if i == 399 else fuel, None, None, cc, 5.0, None if lost else la + rnd.gauss(0, 1), 0.0 if lost else lo + rnd.gauss(0, 1), 9999.0 if lost else year + rnd.gauss(0, 3), None, None))
    rows.append((1000, "T", "Stadt0 Place0", "Wind", None, None, "Germany", 5.0, None, None, None, None, None))
    df = spark.createDataFrame(rows, PLANTS)
    out = {r.row_id: r for r in fill_plants(df).collect()}
    assert len(out) == len(rows)
    for i in range(380, 399):
        r = out[i]
        assert r.lat_filled and r.lon_filled and r.datein_filled and r.lat_how == "mixture"
        assert abs(r.lat - (51 if i % 2 == 0 else 40)) < 1 and abs(r.datein - (2015 if i // 2 % 2 == 0 else 1950)) < 5
    assert out[1000].lat_how == "group" and abs(out[1000].lat - out[0].lat) < 1e-9
    assert not out[5].lat_filled and out[399].fuel_filled
    assert fill_plants(df.limit(0)).count() == 0


def test_predicates_follow_two_valued_logic(spark):
    from regfuse.plans.predicates import compile_query

    df = spark.createDataFrame([(1, "A", 2.0), (2, "A", None), (3, None, 1.0)], "id int, g string, v double")
    ids = lambda q, **v: [r.id for r in df.filter(compile_query(q, v)).orderBy("id").collect()]
    assert ids("not (g == 'A' and v > 1.5)") == [2, 3]
    assert ids("v != v") == [2] and ids("v == v") == [1, 3]
    assert ids("g not in ['A']") == [3] and ids("g in @names", names=["A"]) == [1, 2]
    assert ids("v >= 1 and v < 2") == [3] and ids("g.str.startswith('A')") == [1, 2] and ids("") == [1, 2, 3]
    with pytest.raises(ValueError):
        compile_query("import os")


def test_cleaned_names_and_classes(spark):
    from regfuse.functions.text import classify, cleaned_name, gather_specifications

    rows = [(0, "Powerplant", "", "Natural Gas", None), (1, "an hydro powerplant", "Run of-River", "Run of-River", ""), (2, " another    powerplant with whitespaces", "OCGT", "", ""), (3, " Power II coalition", "Nuclear Power", " Nuclear", "Powerplant"), (4, " Kraftwerk Besonders besonders '2' CHP", "", "", "")]
    df = spark.createDataFrame(rows, "id int, Name string, Fueltype string, Technology string, Set string")
    assert [r[0] for r in df.orderBy("id").select(cleaned_name()).collect()] == ["Powerplant", "An Powerplant", "Another Powerplant With Whitespaces", "Coalition", "Besonders Chp"]
    got = [r for r in gather_specifications(df).orderBy("id").collect()]
    assert [r.Fueltype for r in got[:4]] == ["Natural Gas", "Hydro", "Natural Gas", "Nuclear"]
    assert got[0].Technology == "CCGT" and got[2].Technology == "OCGT" and got[4].Technology is None and got[4].Set == "CHP"
    m = {"Nuclear": "", "Coal": "(?i)Coalition"}
    assert df.filter("id = 3").select(classify(["Name", "Fueltype"], m)).first()[0] == "Coal"


A2 = [(0, "Powerplant", "", "Natural Gas", "", 120.0, 51.5074, -0.1278), (1, "an hydro powerplant", "Run of-River", "Run of-River", "", 40.0, None, None), (2, " another    powerplant with whitespaces", "OCGT", "", "", 80.008, 40.7128, -74.006), (3, " Power II coalition", "Nuclear Power", " Nuclear", "", 90.122, 42.8765, -60.9807), (4, " Kraftwerk Besonders besonders '2' CHP", "", "", "", 400.2, 48.2031, -1.0221)]
LINK_SCHEMA = "id int, Name string, Fueltype string, Technology string, Country string, Capacity double, lat double, lon double"


@pytest.mark.parametrize("prune", [True, False])
def test_scores_of_links(spark, prune):
    from regfuse.operators.linkage import dedup_links, record_links

    a = spark.createDataFrame(A2, LINK_SCHEMA)
    b = spark.createDataFrame([(i, "Plant" if i == 0 else n, f, "Gas" if i == 0 else t, c, 44.5 if i == 2 else cap, la, lo) for i, n, f, t, c, cap, la, lo in A2], LINK_SCHEMA)
    assert [(r.id_a, r.id_b) for r in dedup_links(a, prune=prune).collect()] == [(0, 1)]
    got = {(r.id_a, r.id_b): r.score for r in record_links(a, b, prune=prune).collect()}
    want = {(0, 1): 0.9769736842105264, (1, 1): 0.9985590778097984, (2, 2): 0.9992083247849796, (3, 3): 0.999639379733141, (4, 4): 0.9991589571068124}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cliques(spark):
    from regfuse.operators.aggregate import group_cliques
    from regfuse.operators.linkage import mirrored

    links = mirrored(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "id_a bigint, id_b bigint")).unionByName(spark.createDataFrame([(8, 9)], "id_a bigint, id_b bigint"))
    assert {r.id: r.grouped for r in group_cliques(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 3}


def test_cliques_of_many_components_share_frames(spark):
    from regfuse.operators import aggregate
    from regfuse.operators.linkage import mirrored

    n = 6000
    links = mirrored(spark.range(n).selectExpr("id * 3 as id_a", "id * 3 + 1 as id_b"))
    got = {r.id: r.grouped for r in aggregate.group_cliques(links).collect()}
    assert got == {i: i // 3 * 3 for k in range(n) for i in (3 * k, 3 * k + 1)}
    assert aggregate.CLIQUE_TASKS < n


def test_cross_matches_prefer_full_rows(spark):
    from regfuse.operators.linkage import cross_matches

    pair = lambda rows: spark.createDataFrame(rows, "id_a bigint, id_b bigint, score double")
    out = cross_matches({("A", "B"): pair([(1, 11, 1.0), (2, 12, 1.0)]), ("A", "C"): pair([(1, 21, 1.0)]), ("B", "C"): pair([(12, 22, 1.0)])}, ["A", "B", "C"])
    assert {tuple(r) for r in out.collect()} == {(1, 11, 21), (2, 12, 22)}


def test_readers(spark, tmp_path):
    import zipfile

    from regfuse.sources.importers import apportion_storage, units_and_plants
    from regfuse.sources.readers import parse_literal, read_json_nested, read_zip

    (tmp_path / "p.json").write_text('{"projects": [{"id": 1, "technology": {"name": "Li", "parentName": "Electro-chemical"}}]}')
    assert read_json_nested(spark, str(tmp_path / "p.json"), "projects").first().technology_parentName == "Electro-chemical"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("units_Wind.csv", "id,cap\n1,5\n2,1\n")
        z.writestr("units_Solar.csv", "id,cap,x\n3,9,y\n")
    assert {(r.id, r.Filesuffix) for r in read_zip(spark, str(tmp_path / "z.zip"), ["Wind", "Solar"], ["id", "cap", "x"], where="cast(cap as double) > 2").collect()} == {("1", "Wind"), ("3", "Solar")}
    s = spark.createDataFrame([(10.0, "a, b"), (4.0, "b")], "NutzbareSpeicherkapazitaet double, VerknuepfteEinheit string")
    assert {r.projectID: r.StorageCapacity for r in apportion_storage(s, spark.createDataFrame([("a",), ("b",), ("c",)], "projectID string")).collect()} == {"a": 5.0, "b": 9.0, "c": None}
    u, p = spark.createDataFrame([("1", 5.0)], "projectID string, Capacity double"), spark.createDataFrame([("1", "A"), ("2", "B")], "projectID string, Name string")
    assert {(r.projectID, r.Name, r.Capacity) for r in units_and_plants(u, p).collect()} == {("1", "A", 5.0), ("2", "B", None)}
    assert spark.createDataFrame([("{'GEO': ['1', '2']}",)], "c string").select(parse_literal("c")).first()[0] == {"GEO": ["1", "2"]}


def test_sources_load(spark):
    from regfuse.sources import importers  # noqa: F401
    from regfuse.sources.registry import source, sources

    assert "GEM" in sources()
    raw = spark.createDataFrame([("x", "Foo Power Plant", "Spain", "Hydro", "12.5", "40.0", "-3.0")], "gppd_idnr string, name string, country_long string, primary_fuel string, capacity_mw string, latitude string, longitude string")
    r = source("gpd").load(raw).first()
    assert (r.Name, r.Capacity, r.projectID) == ("Foo", 12.5, "x")


def test_vintages(spark):
    from regfuse.operators.heuristics import vintage_cohorts

    df = spark.createDataFrame([("A", "Wind", 2000, 10.0), ("A", "Wind", 2001, 15.0), ("A", "Wind", 2002, 12.0)], "Country string, Fueltype string, Year int, Capacity double")
    assert {r.DateIn: r.Capacity for r in vintage_cohorts(df).collect()} == {2000.0: 7.0, 2001.0: 5.0}


def test_config_layers(tmp_path):
    from regfuse.config import get_config

    f = tmp_path / "c.yaml"
    f.write_text("main_query: Capacity > 1\nmatching_sources:\n  - A\n  - B: Capacity >= 2\n")
    c = get_config(str(f), target_countries=["Spain"])
    assert c["main_query"] == "Capacity > 1" and c["matching_sources"] == {"A": None, "B": "Capacity >= 2"} and c["target_countries"] == ["Spain"]
    assert get_config()["digest"] == "" and c["digest"] == get_config(target_countries=["Spain"])["digest"]


def test_pruned_links_are_all_links(spark):
    import random

    from regfuse.operators.linkage import dedup_links, record_links

    rnd = random.Random(3)
    names = ["Brunfal Klermond", "Brunfal Klermnod", "Stoldrin", "Dolmarek Tregmald", "Dolmarek"]
    rows = []
    for i in range(160):
        lat, lon = (None, None) if i % 7 == 0 else (rnd.choice([50.0, 71.9, 72.5]) + rnd.random() * 0.03, 10 + rnd.random() * 0.1)
        rows.append((i, rnd.choice(names), rnd.choice(["Oil", "Wind", None]), rnd.choice(["CCGT", None]), rnd.choice(["Norway", None]), rnd.choice([5.0, 6.0, None, 0.0]), lat, lon))
    df = spark.createDataFrame(rows, "id bigint, Name string, Fueltype string, Technology string, Country string, Capacity double, lat double, lon double")
    found = lambda d: {(r.id_a, r.id_b) for r in d.collect()}
    assert found(dedup_links(df)) == found(dedup_links(df, prune=False)) != set()
    a, b = df.filter("id < 60"), df.filter("id >= 60")
    assert found(record_links(a, b)) == found(record_links(a, b, prune=False)) != set()


def test_each_pair_is_met_once_and_links_of_all_registers_in_one_job(spark):
    from itertools import combinations

    from regfuse.operators import linkage

    names, capacity = ["Central Brunfal Klermond C", "Central Brunfal Klerm0nd 4", "Stoldrin Werk", "Stoldrin"], [-999.0, None, 5.0, 0.0, 6.0]
    rows = [(i, names[i % 4], "Gas", "Norway", capacity[i % 5], *((None, None) if i % 3 == 0 else (50.0 + i / 10, 10.0))) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, Name string, Fueltype string, Country string, Capacity double, lat double, lon double")
    found = lambda d: sorted((r.id_a, r.id_b, round(r.score, 9)) for r in d.collect())
    # one first side for rows without a position, and ids of both kinds in either order
    assert found(linkage.dedup_links(df)) == found(linkage.dedup_links(df, prune=False)) != []
    # registers whose ids are the same numbers
    sets = {s: df.filter(f"id >= {k} and id < {k + 20}").withColumn("id", df["id"] - k) for k, s in ((0, "A"), (20, "B"), (40, "C"))}
    links = linkage.link_all(sets)
    assert list(links) == list(combinations(sets, 2))
    for x, y in links:
        assert found(links[x, y]) == found(linkage.compare_two(sets[x], sets[y])) != []


def test_links_read_their_rows_once_and_in_many_parts(spark):
    from regfuse.operators import linkage

    df = spark.createDataFrame([(1, "Brunfal", "Gas", "Norway", 5.0, 50.0, 10.0)], "id bigint, Name string, Fueltype string, Country string, Capacity double, lat double, lon double")
    plan = linkage.dedup_links(df)._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "REPARTITION_BY_NUM" in plan


def test_bounds_of_names_lose_no_pair(spark):
    import random

    import numpy as np

    from regfuse.functions.similarity import jaro_winkler, name_similarity
    from regfuse.operators.pairs import Words, name_scores

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß0-") for _ in range(rnd.choice([1, 2, 5, 8, 9, 30])))
    names = [" ".join(word() for _ in range(rnd.randrange(6))) for _ in range(60)] + [None, "a" * 12 + " b", "aab aba"]
    words = Words(np.array(names, dtype=object))
    i, j = (x.ravel() for x in np.indices((len(names), len(names))))
    want = [np.nan if names[x] is None or names[y] is None else name_similarity(names[x], names[y]) for x, y in zip(i, j)]
    assert np.allclose(name_scores(words, i, j), want, rtol=0, atol=1e-14, equal_nan=True)
    every = np.arange(len(words.words))
    exact = np.array([[jaro_winkler(x, y) for y in words.words] for x in words.words])
    assert (words.bound(every, every) >= exact - 1e-5).all()


def test_unplaced_rows_of_a_block_are_not_all_compared_by_name(spark, monkeypatch):
    import random

    import numpy as np
    import pandas as pd

    from regfuse.functions.similarity import LINK
    from regfuse.operators import pairs

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(7))
    n = 800
    a = pd.DataFrame({"a_name": [f"{word()} {word()}" for _ in range(n)], "a_fuel": "wind", "a_country": "spain", "a_capacity": 5.0, "a_lat": np.nan, "a_lon": np.nan})
    b = a.rename(columns=lambda c: c.replace("a_", "b_")).assign(b_name=[x[:-1] + "z" for x in a["a_name"]])
    block = pairs.Block(a, b, LINK)
    i, j = (np.concatenate(x) for x in zip(*block.candidates()))
    assert set(zip(range(n), range(n, 2 * n))) <= set(zip(i.tolist(), j.tolist())) and len(i) < n * n // 50
    at, _ = block.score(i, j, False)
    assert len(at) >= n


def test_nearest_bus_keeps_repeated_rows(spark):
    from regfuse.operators.export import nearest_bus

    rows = spark.createDataFrame([(50.0, 10.0, "A"), (50.0, 10.0, "A"), (None, 10.0, "A"), (-999.0, -999.0, "A"), (50.0, 10.0, None)], "lat double, lon double, Country string")
    buses = spark.createDataFrame([(1, 10.1, 50.0, "A"), (2, 10.0, 50.05, "B"), (3, None, 1.0, "A")], "bus int, x double, y double, country string")
    assert sorted((r.bus or 0) for r in nearest_bus(rows, buses).collect()) == [0, 2, 2, 2, 2]
    assert sorted((r.bus or 0) for r in nearest_bus(rows, buses, by_country=True).collect()) == [0, 0, 1, 1, 1]
    assert nearest_bus(rows.limit(0), buses).count() == 0 and nearest_bus(rows, buses.limit(0)).filter("bus is null").count() == 5


def test_rules_of_the_register(spark):
    from pyspark.sql import functions as F

    from regfuse.operators.export import network_parts, times_stock, times_types
    from regfuse.operators.heuristics import denmark_regions, known_retire_years, uncommon_fuels_to_other, vre_by_commissioning_year

    rows = [("Jetsmark", "Wind", "Offshore", "PP", "Denmark", 4.0, 2000.0, None, 12.0), ("Isar 2", "Nuclear", None, "PP", "Germany", 10.0, 1980.0, None, 11.0), ("X", "Geothermal", None, "CHP", "Italy", 2.0, 2000.0, 3.0, 9.0), ("Y", "Geothermal", None, "PP", "Italy", 2.0, 2000.0, None, 9.0), ("Z", "Mixed fuel types", None, "PP", None, 1.0, None, None, None), ("B", "Biogas", None, "PP", "Spain", 1.0, 2001.0, None, None)]
    df = spark.createDataFrame(rows, "Name string, Fueltype string, Technology string, Set string, Country string, Capacity double, DateIn double, Duration double, lon double").withColumns({"DateRetrofit": F.lit(None).cast("double"), "lat": F.lit(50.0)})
    assert [r.Region for r in denmark_regions(df).filter("Country = 'Denmark'").collect()] == ["DKW"]
    assert {r.Fueltype for r in uncommon_fuels_to_other(df).collect()} == {"Wind", "Nuclear", "Geothermal", "Other", "Biogas"}
    assert [r.YearRetire for r in known_retire_years(df).filter("YearRetire is not null").collect()] == [2022.0]
    _, others = network_parts(df.withColumn("bus", F.col("Country")))
    geo = others.filter("carrier = 'geothermal'").collect()
    assert len(geo) == 1 and geo[0].component == "PP" and geo[0].p_nom == 4.0 and geo[0].max_hours == 1.5
    assert {(r.Fueltype, r.DateRetrofit) for r in vre_by_commissioning_year(df).collect()} == {("Wind", 2000.0), ("Biogas", 2001.0)}
    types = {r.Name: (r.TimesType, r.Life, r.YearRetire) for r in times_types(df).collect()}
    assert types["Jetsmark"] == ("ConELC-PP_WOF", 25.0, 2025.0) and types["X"] == ("ConELC-CHP_GEO", 30.0, 2030.0) and types["Isar 2"] == ("ConELC-PP_NUC", 50.0, 2022.0) and types["Z"][0] is None
    assert {(r.TimesType, r.Region, r.Year) for r in times_stock(df, 2015, 2025).filter("TimesType = 'ConELC-PP_WOF'").collect()} == {("ConELC-PP_WOF", "DKW", 2015), ("ConELC-PP_WOF", "DKW", 2020)}


def test_importers_leave_out_other_lists(spark):
    from regfuse.sources.registry import source

    gpd = spark.createDataFrame([("Alpha", "1", "Spain", "Gas", 5.0, 40.0, 1.0, 2000, "GEODB"), ("Beta", "2", "Spain", "Gas", 5.0, 40.0, 1.0, 2000, "Own"), ("Gamma", "3", "Spain", "Gas", 5.0, 40.0, 1.0, 2000, None)], "name string, gppd_idnr string, country_long string, primary_fuel string, capacity_mw double, latitude double, longitude double, commissioning_year int, source string")
    assert {r.projectID for r in source("GPD").load(gpd).collect()} == {"2", "3"}
    wiki = spark.createDataFrame([("Aname", "In Bau", "2019"), ("Bname", "In Betrieb", "1980")], "Name string, Status string, DateIn string")
    assert {r.DateIn for r in source("WIKIPEDIA").load(wiki).collect()} == {2027.0, 1980.0}
    eu = spark.createDataFrame([("Oldwerk", "Lignite", "Steam turbine", "DE", 5.0, "e1", 1980.0), ("BNA1 Werk", "Lignite", "Steam turbine", "FR", 5.0, "e2", 1980.0), ("Newwerk", "Lignite", "Steam turbine", "FR", 5.0, "e3", 1980.0)], "name string, energy_source string, technology string, country string, capacity double, eic_code string, commissioned double")
    de = spark.createDataFrame([("Dewerk", None, "Hard coal", None, "Steam turbine", "DE", 7.0, "BNA2", 1990.0, None)], "name_bnetza string, name_uba string, energy_source string, fuel string, technology string, country_code string, capacity_net_bnetza double, id string, commissioned double, shutdown double")
    assert {(r.Name, r.DateRetrofit) for r in source("OPSD").load(eu, de).collect()} == {("Newwerk", 1980.0), ("Dewerk", None)}


def test_fused_table(spark):
    from regfuse.collection import collect, powerplants
    from regfuse.config import get_config
    from regfuse.schema import conform

    cols = "id bigint, Name string, Fueltype string, Technology string, Country string, Capacity double, lat double, lon double, projectID string"
    a = [(1, "Brunfal Klermond", "Oil", None, "Spain", 5.0, 40.0, 1.0, "a1"), (2, "Brunfal Klermond", "Oil", None, "Spain", 6.0, 40.0, 1.0, "a2"), (3, "Stoldrin", "Wind", None, "Spain", 6.0, 41.0, 1.0, "a3")]
    b = [(11, "Brunfal Klermond", "Oil", "CCGT", "Spain", 11.0, 40.001, 1.0, "b1"), (12, "Halvorm", "Wind", None, "Spain", 2.0, None, None, "b2")]
    sets = {n: conform(spark.createDataFrame(r, cols), ["id"]) for n, r in (("A", a), ("B", b))}
    config = get_config(matching_sources=["A", "B"], fully_included_sources={"A": None, "B": None}, reliability={"A": 1.0, "B": 2.0})
    matched = collect(sets, config).collect()
    assert len(matched) == 1 and matched[0].projectID == {"A": ["a1", "a2"], "B": ["b1"]} and matched[0].Capacity == 11.0
    got = {tuple(sorted(i for v in r.projectID.values() for i in v)) for r in powerplants(sets, config, only_placed=False).collect()}
    assert got == {("a1", "a2", "b1"), ("a3",), ("b2",)}
    assert powerplants(sets, config).count() == 2


def test_unit_links_are_found_once(spark, monkeypatch):
    from regfuse import collection
    from regfuse.config import get_config
    from regfuse.schema import conform

    calls, found = [], collection.dedup_links
    monkeypatch.setattr(collection, "dedup_links", lambda *args, **kwargs: calls.append(1) or found(*args, **kwargs))
    cols = "id bigint, Name string, Fueltype string, Technology string, Country string, Capacity double, lat double, lon double, projectID string"
    a = [(i, "Brunfal Klermond", "Oil", None, "Spain", c, 40.0, 1.0, f"a{i}") for i, c in ((1, 5.0), (2, 6.0), (3, 0.5))]
    b = [(i, "Halvorm", "Wind", None, "Spain", 2.0, 50.0, 1.0, f"b{i}") for i in (11, 12)]
    sets = {n: conform(spark.createDataFrame(r, cols), ["id"]) for n, r in (("A", a), ("B", b))}
    config = get_config(matching_sources=["A", "B"], fully_included_sources={"A": "Capacity >= 1", "B": None}, reliability={"A": 1.0, "B": 2.0})
    got = {tuple(sorted(i for v in r.projectID.values() for i in v)) for r in collection.powerplants(sets, config).collect()}
    # the third unit is too small for the filter, the other two stay linked
    assert got == {("a1", "a2"), ("b11", "b12")} and len(calls) == 1
