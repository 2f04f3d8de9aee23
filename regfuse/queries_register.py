"""Queries of the register operators over the stacked test table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfuse.schema import from_table
from regfuse.session import table

NUMBERS = ["Capacity", "Efficiency", "DateIn", "DateRetrofit", "DateOut", "lat", "lon", "Duration", "Volume_Mm3", "DamHeight_m", "StorageCapacity_MWh"]
#: The table in the target schema as SQL: NaN is null, columns in lower case.
P = "WITH p AS (SELECT row_id, source_name AS source, name, fueltype, technology, set_type AS \"set\", country, eic, projectid, grouped, " + ", ".join(f"CASE WHEN NOT isnan({c.lower()}) THEN {c.lower()} END AS {c.lower()}" for c in NUMBERS) + " FROM powerplants)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{P}", P)
        return f

    return add


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = from_table(table(spark, sf_dir, "powerplants"))
    return df.toDF(*[c.lower() for c in df.columns]).withColumnsRenamed({c.lower(): c for c in ["Name", "Fueltype", "Technology", "Set", "Country", "EIC", "projectID", *NUMBERS]})


def with_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "powerplants")
    df = raw.withColumnRenamed("set_type", "Set")
    return df.withColumns({c.lower(): F.when(~F.isnan(c.lower()), F.col(c.lower())) for c in NUMBERS}).withColumnRenamed("source_name", "source")


def lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def r6(*cols: str) -> dict:
    return {c: F.round(c, 6) for c in cols}


@query("{P} SELECT country, fueltype, round(coalesce(sum(capacity), 0), 3) AS capacity FROM p WHERE country IS NOT NULL AND fueltype IS NOT NULL GROUP BY ALL")
def lookup_country_fuel(spark, sf):
    from regfuse.operators.aggregate import lookup

    return lower(lookup(plants(spark, sf)))


@query("{P} SELECT country, round(coalesce(sum(capacity), 0) / 1000, 3) AS capacity FROM p WHERE country IS NOT NULL AND NOT coalesce(fueltype IN ('Solar', 'Wind'), false) GROUP BY ALL")
def lookup_gw_excluding(spark, sf):
    from regfuse.operators.aggregate import lookup

    return lower(lookup(plants(spark, sf), "Country", ["Solar", "Wind"], "GW"))


@query("{P} SELECT country, coalesce(round(sum(capacity) FILTER (source = 'GEOLIST'), 3), 0) AS geolist, coalesce(round(sum(capacity) FILTER (source = 'MARKTREG'), 3), 0) AS marktreg FROM p WHERE country IS NOT NULL AND source IN ('GEOLIST', 'MARKTREG') GROUP BY ALL")
def lookup_multi(spark, sf):
    from regfuse.operators.aggregate import lookup_many

    p = plants(spark, sf)
    return lower(lookup_many({s: p.filter(F.col("source") == s) for s in ("GEOLIST", "MARKTREG")}, "Country"))


@query("{P} SELECT country, fueltype, round(sum(capacity), 3) AS capacity FROM p WHERE country IS NOT NULL AND fueltype IS NOT NULL GROUP BY ROLLUP (country, fueltype)")
def lookup_total_rollup(spark, sf):
    from regfuse.operators.aggregate import totals

    return lower(totals(plants(spark, sf), ["Country", "Fueltype"]))


@query("{P} SELECT row_id, name, fueltype, country, capacity FROM p WHERE name <> '' AND coalesce(lat >= 30, true) AND country IN ('Germany', 'France', 'Spain') AND fueltype IN ('Hydro', 'Wind')")
def conform_filter(spark, sf):
    from regfuse.sources.registry import config_filter

    p = plants(spark, sf).filter(F.col("Name").isNotNull())
    return lower(config_filter(p, ["Germany", "France", "Spain"], ["Hydro", "Wind"]).select("row_id", "Name", "Fueltype", "Country", "Capacity"))


@query("{P} SELECT row_id FROM p WHERE NOT (coalesce(country = 'Germany', false) AND coalesce(capacity >= 10, false)) AND NOT coalesce(fueltype IN ('Oil', 'Nuclear'), false) AND (coalesce(datein >= 2000, false) OR datein IS NULL)")
def predicate_pandas_null(spark, sf):
    from regfuse.plans.predicates import compile_query

    q = "not (Country == 'Germany' and Capacity >= 10) and Fueltype not in ['Oil', 'Nuclear'] and (DateIn >= 2000 or DateIn != DateIn)"
    return plants(spark, sf).filter(compile_query(q)).select("row_id")


@query("""{P}, c AS (SELECT projectid, max(capacity) AS c_capacity, max(technology) AS c_technology FROM p WHERE source = 'MARKTREG' AND grouped IS NOT NULL GROUP BY projectid)
SELECT row_id, projectid, coalesce(c_capacity, capacity) AS capacity, coalesce(c_technology, technology) AS technology FROM p LEFT JOIN c USING (projectid)""")
def manual_corrections(spark, sf):
    from regfuse.operators.fuse import manual_corrections as correct

    g = with_grouped(spark, sf)
    fixes = g.filter("source = 'MARKTREG' and grouped is not null").groupBy("projectid").agg(F.max("capacity").alias("capacity"), F.max("technology").alias("technology"))
    return correct(g.select("row_id", "projectid", "capacity", "technology"), fixes, "projectid").select("row_id", "projectid", "capacity", "technology")


@query("""{P} SELECT row_id, CASE WHEN regexp_matches(coalesce(fueltype, ''), '(?i)\\bwind\\b') OR regexp_matches(coalesce(technology, ''), '(?i)\\bwind\\b') THEN 'Wind'
 WHEN regexp_matches(coalesce(fueltype, ''), '(?i)\\bsolar\\b|\\bsolaire\\b') OR regexp_matches(coalesce(technology, ''), '(?i)\\bsolar\\b|\\bsolaire\\b') THEN 'Solar'
 WHEN regexp_matches(coalesce(fueltype, ''), '(?i)\\bgas\\b|\\bccgt\\b|\\bocgt\\b') OR regexp_matches(coalesce(technology, ''), '(?i)\\bgas\\b|\\bccgt\\b|\\bocgt\\b') THEN 'Natural Gas' ELSE 'Other' END AS gathered FROM p""".replace("\\\\b", "\\b"))
def classify_last_match(spark, sf):
    from regfuse.functions.text import gather_and_replace

    m = {"Other": ".*", "Natural Gas": ["gas", "ccgt", "ocgt"], "Solar": ["solar", "solaire"], "Wind": ""}
    return gather_and_replace(plants(spark, sf), m, ["Fueltype", "Technology"]).select("row_id", "gathered")


@query()
def gather_specifications(spark, sf):
    from regfuse.functions.text import gather_specifications as gather

    return lower(gather(plants(spark, sf)).select("row_id", "Fueltype", "Technology", "Set"))


@query()
def clean_name(spark, sf):
    from regfuse.functions.text import clean_name as clean

    return lower(clean(plants(spark, sf)).select("row_id", "Name"))


@query("{P} SELECT row_id, CASE technology WHEN 'Combustion Engine' THEN 'CCGT' WHEN 'Pv' THEN 'PV' WHEN 'CSP' THEN 'Csp' ELSE technology END AS technology FROM p")
def clean_technology(spark, sf):
    from regfuse.functions.text import clean_technology as clean

    return lower(clean(plants(spark, sf)).select("row_id", "Technology"))


@query("""WITH c AS (SELECT row_id, lower(trim(country)) AS k FROM powerplants), names AS (SELECT alpha_2, lower(alpha_2) AS k FROM country_codes UNION ALL SELECT alpha_2, lower(alpha_3) FROM country_codes UNION ALL SELECT alpha_2, lower(name) FROM country_codes
UNION ALL VALUES ('GR', 'el'), ('GB', 'uk'), ('GB', 'great britain'), ('DE', 'deutschland'), ('ES', 'españa'), ('IT', 'italia'), ('PL', 'polska'), ('AT', 'österreich'), ('CH', 'schweiz'), ('CH', 'suisse'), ('SE', 'sverige'), ('NO', 'norge'), ('GR', 'hellas'), ('NL', 'the netherlands'), ('CZ', 'czech republic'), ('MK', 'macedonia'))
SELECT row_id, alpha_2 FROM c LEFT JOIN names USING (k)""")
def country_alpha2(spark, sf):
    from regfuse.functions.vocab import country_code

    return table(spark, sf, "powerplants").select("row_id", country_code("country").alias("alpha_2"))


_SIMILAR = """
, r AS (SELECT row_id AS id, source, nullif(trim(regexp_replace(replace(replace(replace(replace(strip_accents(lower(name)), 'ß', 'ss'), 'ł', 'l'), 'ø', 'o'), 'đ', 'd'), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g')), '') AS name, nullif(trim(replace(replace(replace(replace(strip_accents(lower(fueltype)), 'ß', 'ss'), 'ł', 'l'), 'ø', 'o'), 'đ', 'd')), '') AS fuel, nullif(trim(replace(replace(replace(replace(strip_accents(lower(technology)), 'ß', 'ss'), 'ł', 'l'), 'ø', 'o'), 'đ', 'd')), '') AS tech, country, capacity, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END AS lon FROM p {where}),
q AS (SELECT *, coalesce(country, '') AS b1, CASE WHEN length(fuel) < 2 THEN [fuel] ELSE list_distinct(list_transform(range(1, length(fuel)), lambda i: fuel[i:i+1])) END AS fq, CASE WHEN length(tech) < 2 THEN [tech] ELSE list_distinct(list_transform(range(1, length(tech)), lambda i: tech[i:i+1])) END AS tq, string_split(name, ' ') AS w FROM r),
s AS (SELECT a.id AS id_a, b.id AS id_b,
 CASE WHEN a.name = b.name THEN 1.0 WHEN len(a.w) <= len(b.w) THEN list_avg(list_transform(a.w, lambda x: list_max(list_transform(b.w, lambda y: jaro_winkler_similarity(x, y))))) ELSE list_avg(list_transform(b.w, lambda x: list_max(list_transform(a.w, lambda y: jaro_winkler_similarity(x, y))))) END AS s_name,
 CASE WHEN a.fuel IS NULL OR b.fuel IS NULL THEN NULL WHEN a.fuel = b.fuel THEN 1.0 ELSE len(list_intersect(a.fq, b.fq)) / least(len(a.fq), len(b.fq))::DOUBLE END AS s_fuel, CASE WHEN a.tech IS NULL OR b.tech IS NULL THEN NULL WHEN a.tech = b.tech THEN 1.0 ELSE len(list_intersect(a.tq, b.tq)) / least(len(a.tq), len(b.tq))::DOUBLE END AS s_tech,
 CASE WHEN a.country = b.country THEN 1.0 END AS s_country, CASE WHEN a.capacity IS NULL OR b.capacity IS NULL OR a.capacity = 0 OR b.capacity = 0 THEN NULL WHEN a.capacity * b.capacity < 0 THEN 0.0 ELSE least(abs(a.capacity), abs(b.capacity)) / greatest(abs(a.capacity), abs(b.capacity)) END AS s_cap,
 CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN greatest(0.0, 1 - 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) / 5.0) END AS s_geo
 FROM q a JOIN q b ON a.b1 = b.b1 AND {on}),
o AS (SELECT id_a, id_b, {odds} AS odds FROM s)"""


def _odds(bounds: dict[str, tuple[float, float]]) -> str:
    cols = {"name": "s_name", "fuel": "s_fuel", "technology": "s_tech", "country": "s_country", "capacity": "s_cap", "geo": "s_geo"}
    p = lambda k, lo, hi: f"coalesce((CASE WHEN {cols[k]} >= 0.5 THEN {hi - 0.5} * {cols[k]} * {cols[k]} + 0.5 WHEN {cols[k]} < 0.5 THEN {lo} END), 0.5)"
    return " * ".join(f"({p(k, *b)} / (1 - {p(k, *b)}))" for k, b in bounds.items())


_DEDUP = {"name": (0.09, 0.99), "fuel": (0.05, 0.65), "technology": (0.25, 0.51), "country": (0.05, 0.51), "capacity": (0.49, 0.51), "geo": (0.05, 0.75)}
_LINK = {"name": (0.09, 0.99), "fuel": (0.09, 0.7), "country": (0.0, 0.53), "capacity": (0.3, 0.75), "geo": (0.1, 0.8)}


@query("{P}" + _SIMILAR.replace("{where}", "").replace("{on}", "a.id < b.id AND a.source = b.source").replace("{odds}", _odds(_DEDUP)) + " SELECT id_a, id_b, round(odds / (1 + odds), 6) AS score FROM o WHERE odds >= 24 - 1e-9")
def dedup_links(spark, sf):
    from regfuse.operators.linkage import dedup_links as links

    p = plants(spark, sf).withColumnRenamed("row_id", "id")
    return links(p, [F.coalesce("Country", F.lit("")), "source"]).withColumns(r6("score"))


@query("{P}" + _SIMILAR.replace("{where}", "WHERE source IN ('GEOLIST', 'MARKTREG')").replace("{on}", "a.source = 'GEOLIST' AND b.source = 'MARKTREG'").replace("{odds}", _odds(_LINK)) + " SELECT id_a, id_b, round(odds / (1 + odds), 6) AS score FROM o WHERE odds >= 0.965 / 0.035 - 1e-9")
def record_links(spark, sf):
    from regfuse.operators.linkage import record_links as links

    a, b = _two(spark, sf)
    return links(a, b, _BLOCK()).withColumns(r6("score"))


def _BLOCK():
    return [F.coalesce("Country", F.lit(""))]


def _two(spark, sf):
    p = plants(spark, sf).withColumnRenamed("row_id", "id")
    return p.filter("source = 'GEOLIST'"), p.filter("source = 'MARKTREG'")


@query("{P}" + _SIMILAR.replace("{where}", "WHERE source IN ('GEOLIST', 'MARKTREG')").replace("{on}", "a.source = 'GEOLIST' AND b.source = 'MARKTREG'").replace("{odds}", _odds(_LINK)) + """,
l AS (SELECT id_a, id_b, round(odds / (1 + odds), 9) AS score FROM o WHERE odds >= 0.965 / 0.035 - 1e-9), f AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS k FROM l), g AS (SELECT *, row_number() OVER (PARTITION BY id_b ORDER BY score DESC, id_a) AS m FROM f WHERE k = 1)
SELECT id_a, id_b, round(score, 6) AS score FROM g WHERE m = 1""")
def best_links(spark, sf):
    from regfuse.operators.linkage import best_matches
    from regfuse.operators.linkage import record_links as links

    a, b = _two(spark, sf)
    return best_matches(links(a, b, _BLOCK()).withColumn("score", F.round("score", 9))).withColumns(r6("score"))


@query()
def cross_match3(spark, sf):
    from regfuse.operators.linkage import cross_matches, link_all

    p = plants(spark, sf).withColumnRenamed("row_id", "id")
    names = ["GEOLIST", "HYDROBOOK", "TSOLIST"]
    return lower(cross_matches(link_all({n: p.filter(F.col("source") == n) for n in names}, _BLOCK()), names))


@query()
def unit_cliques(spark, sf):
    from regfuse.operators.aggregate import group_cliques
    from regfuse.operators.linkage import dedup_links as links
    from regfuse.operators.linkage import mirrored

    p = plants(spark, sf).withColumnRenamed("row_id", "id")
    return group_cliques(mirrored(links(p, [*_BLOCK(), "source"])))


_AGG = """SELECT grouped, nullif(sum(capacity), 0) AS capacity, nullif(avg(lat), 0) AS lat, nullif(min(datein), 0) AS datein, nullif(max(dateout), 0) AS dateout, sum(duration * capacity) / nullif(sum(capacity), 0) AS duration, count(DISTINCT projectid) AS ids FROM p WHERE grouped IS NOT NULL GROUP BY grouped"""


@query("{P} SELECT grouped, round(capacity, 6) AS capacity, round(lat, 6) AS lat, datein, dateout, round(nullif(duration, 0), 6) AS duration, ids FROM (" + _AGG + ")")
def aggregate_units(spark, sf):
    from regfuse.operators.aggregate import aggregate_groups

    g = aggregate_groups(with_grouped(spark, sf).filter("grouped is not null"), ["grouped"])
    return lower(g.select("grouped", F.round("Capacity", 6).alias("capacity"), F.round("lat", 6).alias("lat"), "DateIn", "DateOut", F.round("Duration", 6).alias("duration"), F.size("projectID").cast("bigint").alias("ids")))


@query("""{P}, f AS (SELECT *, coalesce(fueltype, '') AS v FROM p WHERE grouped IS NOT NULL), n AS (SELECT grouped, v, count(*) AS k FROM f GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY grouped ORDER BY k DESC, v) AS r FROM n) SELECT grouped, nullif(v, '') AS fueltype FROM w WHERE r = 1""")
def aggregate_mode(spark, sf):
    from regfuse.operators.aggregate import smallest_mode

    return with_grouped(spark, sf).filter("grouped is not null").groupBy("grouped").agg(smallest_mode("fueltype").alias("fueltype"))


def _matched(spark, sf):
    """Rows of several registers under one name and country, as matches."""
    g = with_grouped(spark, sf).filter("name is not null and country is not null").withColumn("match_id", F.concat_ws("|", F.lower("name"), "country"))
    g = g.withColumn("_r", F.row_number().over(_w(["match_id", "source"], ["row_id"]))).filter("_r = 1").drop("_r")
    several = g.groupBy("match_id").count().filter("count > 1").select("match_id")
    return g.join(several, "match_id", "left_semi").withColumnsRenamed({"eic": "EIC", "projectid": "projectID", "name": "Name", "fueltype": "Fueltype", "datein": "DateIn", "dateretrofit": "DateRetrofit", "dateout": "DateOut", "capacity": "Capacity", "technology": "Technology", "country": "Country"})


def _w(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def _trust(spark, sf) -> dict[str, float]:
    return {r.source_name: float(r.reliability_score) for r in table(spark, sf, "data_sources").limit(10_000).collect()}


_MATCHED = """{P}, m0 AS (SELECT *, concat_ws('|', lower(name), country) AS match_id FROM p WHERE name IS NOT NULL AND country IS NOT NULL),
m1 AS (SELECT *, row_number() OVER (PARTITION BY match_id, source ORDER BY row_id) AS rr FROM m0), m2 AS (SELECT * FROM m1 WHERE rr = 1), m AS (SELECT m2.*, d.reliability_score AS rel FROM m2 JOIN data_sources d ON d.source_name = m2.source WHERE match_id IN (SELECT match_id FROM m2 GROUP BY match_id HAVING count(*) > 1))"""


@query(_MATCHED + """ SELECT match_id, arg_min(capacity, (-rel, source)) FILTER (capacity IS NOT NULL) AS capacity, coalesce(arg_min("set", (-rel, source)) FILTER ("set" <> 'PP'), 'PP') AS "set", coalesce(arg_min(fueltype, (-rel, source)) FILTER (fueltype <> 'Other'), 'Other') AS fueltype, min(datein) AS datein, max(dateretrofit) AS dateretrofit, count(DISTINCT source) AS sources FROM m GROUP BY match_id""")
def reduce_by_reliability(spark, sf):
    from regfuse.operators.fuse import reduce_matched

    out = reduce_matched(_matched(spark, sf), _trust(spark, sf))
    return lower(out.select("match_id", "Capacity", "Set", "Fueltype", "DateIn", "DateRetrofit", F.size("projectID").cast("bigint").alias("sources")))


@query(_MATCHED + ", x AS (SELECT projectid FROM p WHERE source = 'GEOLIST' AND projectid NOT IN (SELECT projectid FROM m WHERE source = 'GEOLIST')) SELECT 'GEOLIST' AS label, projectid FROM x UNION ALL SELECT source, projectid FROM m")
def extend_non_matched(spark, sf):
    from regfuse.operators.fuse import extend_by_non_matched, reduce_matched

    reduced = reduce_matched(_matched(spark, sf), _trust(spark, sf))
    extra = plants(spark, sf).filter("source = 'GEOLIST'").drop("row_id", "source")
    return extend_by_non_matched(reduced, extra, "GEOLIST").select(F.explode("projectID").alias("label", "_i")).select("label", F.explode("_i").alias("projectid"))


def _parts(spark, sf):
    from regfuse.operators.fuse import breakdown, reduce_matched

    reduced = reduce_matched(_matched(spark, sf), _trust(spark, sf))
    p = plants(spark, sf)
    return breakdown(reduced, {s: p.filter(F.col("source") == s).drop("source") for s in sorted(_trust(spark, sf))})


_PARTS = _MATCHED + ", b AS (SELECT m.match_id, m.source, m.rel, p.row_id FROM (SELECT DISTINCT match_id, source, rel, projectid FROM m) m JOIN p ON p.source = m.source AND p.projectid = m.projectid)"


@query(_PARTS + " SELECT match_id, source, row_id FROM b")
def breakdown(spark, sf):
    return _parts(spark, sf).select("match_id", "source", "row_id")


@query(_PARTS + ", n AS (SELECT match_id, source, rel, count(*) AS k FROM b GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY k DESC, rel DESC, source) AS r FROM n) SELECT b.match_id, b.source, b.row_id FROM b JOIN w USING (match_id, source) WHERE r = 1")
def restore_blocks_1(spark, sf):
    from regfuse.operators.fuse import restore_blocks

    return restore_blocks(_parts(spark, sf), _trust(spark, sf), 1).select("match_id", "source", "row_id")


@query(_PARTS + ", n AS (SELECT DISTINCT match_id, source, rel FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rel DESC, source) AS r FROM n) SELECT b.match_id, b.source, b.row_id FROM b JOIN w USING (match_id, source) WHERE r = 1")
def restore_blocks_2(spark, sf):
    from regfuse.operators.fuse import restore_blocks

    return restore_blocks(_parts(spark, sf), _trust(spark, sf), 2).select("match_id", "source", "row_id")


_COMM = """{P}, a AS (SELECT *, coalesce(datein, CASE WHEN technology IS NOT NULL AND country IS NOT NULL AND fueltype IS NOT NULL THEN avg(datein) OVER (PARTITION BY fueltype, technology, country) END) AS d1 FROM p),
b AS (SELECT *, coalesce(d1, CASE WHEN country IS NOT NULL AND fueltype IS NOT NULL THEN avg(d1) OVER (PARTITION BY fueltype, country) END) AS d2 FROM a), c AS (SELECT *, coalesce(d2, CASE WHEN fueltype IS NOT NULL THEN avg(d2) OVER (PARTITION BY fueltype) END) AS d3 FROM b)"""


@query(_COMM + " SELECT row_id, round(d3, 6) AS datein, round(coalesce(dateretrofit, d3), 6) AS dateretrofit FROM c")
def fill_commissioning(spark, sf):
    from regfuse.operators.heuristics import fill_missing_commissioning_years

    return lower(fill_missing_commissioning_years(plants(spark, sf)).select("row_id", "DateIn", "DateRetrofit").withColumns(r6("DateIn", "DateRetrofit")))


@query(_COMM + " SELECT row_id, round(coalesce(dateout, greatest(d3, coalesce(dateretrofit, d3)) + CASE fueltype WHEN 'Solid Biomass' THEN 20 WHEN 'Biogas' THEN 20 WHEN 'Geothermal' THEN 15 WHEN 'Hard Coal' THEN 45 WHEN 'Hydro' THEN 100 WHEN 'Lignite' THEN 45 WHEN 'Natural Gas' THEN 40 WHEN 'Nuclear' THEN 50 WHEN 'Oil' THEN 40 WHEN 'Other' THEN 5 WHEN 'Solar' THEN 25 WHEN 'Waste' THEN 25 WHEN 'Wind' THEN 25 END), 6) AS dateout FROM c")
def fill_decommissioning(spark, sf):
    from regfuse.operators.heuristics import fill_missing_decommissioning_years

    return lower(fill_missing_decommissioning_years(plants(spark, sf)).select("row_id", "DateOut").withColumns(r6("DateOut")))


@query("""{P}, f AS (SELECT fueltype, avg(duration) AS d FROM p WHERE "set" IN ('Store', 'Storage') AND fueltype IS NOT NULL GROUP BY fueltype) SELECT row_id, round(CASE WHEN "set" IN ('Store', 'Storage') THEN d ELSE duration END, 6) AS duration FROM p LEFT JOIN f USING (fueltype)""")
def fill_duration(spark, sf):
    from regfuse.operators.heuristics import fill_missing_duration

    return lower(fill_missing_duration(plants(spark, sf)).select("row_id", F.round("Duration", 6).alias("Duration")))


@query("""{P}, o AS (SELECT country, fueltype, sum(capacity) AS own FROM p WHERE source = 'GEOLIST' AND country IS NOT NULL AND fueltype IS NOT NULL GROUP BY ALL), s AS (SELECT country, fueltype, sum(capacity) AS stat FROM p WHERE source = 'MARKTREG' AND country IS NOT NULL AND fueltype IS NOT NULL GROUP BY ALL)
SELECT row_id, round(capacity * coalesce(CASE WHEN own <> 0 AND stat / own > 0 THEN stat / own END, 1), 4) AS scaled_capacity FROM p LEFT JOIN o USING (country, fueltype) LEFT JOIN s USING (country, fueltype) WHERE source = 'GEOLIST'""")
def rescale_totals(spark, sf):
    from regfuse.operators.heuristics import rescale_to_totals

    p = plants(spark, sf)
    return lower(rescale_to_totals(p.filter("source = 'GEOLIST'"), p.filter("source = 'MARKTREG'")).select("row_id", F.round("Scaled Capacity", 4).alias("Scaled Capacity")))


_NET = """{P}, n AS (SELECT fueltype, technology, avg(net / gross) AS factor FROM (SELECT g.fueltype, g.technology, min(n.capacity) AS net, g.capacity AS gross FROM (SELECT DISTINCT lower(name) AS nm, country, fueltype, technology, capacity FROM p WHERE source = 'GEOLIST' AND capacity > 0) g JOIN (SELECT lower(name) AS nm, country, capacity FROM p WHERE source = 'MARKTREG' AND capacity > 0) n USING (nm, country) GROUP BY ALL) WHERE net / gross <= 1 AND fueltype IS NOT NULL AND technology IS NOT NULL GROUP BY ALL)"""


def _factors(spark, sf):
    from regfuse.operators.heuristics import gross_to_net_factors

    p = plants(spark, sf).filter("Capacity > 0").withColumn("nm", F.lower("Name"))
    g = p.filter("source = 'GEOLIST'").select("nm", "Country", "Fueltype", "Technology", F.col("Capacity").alias("gross")).distinct()
    n = p.filter("source = 'MARKTREG'").select("nm", "Country", F.col("Capacity").alias("net"))
    both = g.join(n, ["nm", "Country"]).groupBy("Fueltype", "Technology", "gross").agg(F.min("net").alias("net"))
    return gross_to_net_factors(both, "gross", "net")


@query(_NET + " SELECT fueltype, technology, round(factor, 6) AS factor FROM n")
def net_factors(spark, sf):
    return lower(_factors(spark, sf).withColumns(r6("factor")))


@query(_NET + ", r AS (SELECT fueltype, avg(factor) AS f2 FROM n GROUP BY fueltype) SELECT row_id, round(capacity * coalesce(n.factor, r.f2, 1), 5) AS capacity FROM p LEFT JOIN n USING (fueltype, technology) LEFT JOIN r USING (fueltype) WHERE source = 'GEOLIST'")
def net_scaling(spark, sf):
    from regfuse.operators.heuristics import scale_to_net_capacities

    return lower(scale_to_net_capacities(plants(spark, sf).filter("source = 'GEOLIST'"), _factors(spark, sf)).select("row_id", F.round("Capacity", 5).alias("Capacity")))


_COMM_VRE = _COMM.replace("FROM p)", "FROM p WHERE fueltype IN ('Wind', 'Solar', 'Biogas', 'Solid Biomass'))")


def _cohorts(spark, sf, geo):
    from regfuse.operators.heuristics import vre_by_commissioning_year

    out = vre_by_commissioning_year(plants(spark, sf), None, geo)
    if geo == "wm":
        out = out.withColumns({c: F.round(c, 4) for c in ("lat", "lon")})
    return lower(out.withColumns(r6(*[c for c in ("Capacity", "lat", "lon") if c in out.columns], "DateIn", "DateRetrofit")))


_BY = " FROM c WHERE country IS NOT NULL AND d3 IS NOT NULL GROUP BY country, d3, fueltype, technology"


@query(_COMM_VRE + " SELECT country, round(d3, 6) AS datein, round(d3, 6) AS dateretrofit, fueltype, technology, round(sum(capacity), 6) AS capacity, 'PP' AS \"set\"" + _BY)
def vre_cohorts(spark, sf):
    return _cohorts(spark, sf, None)


@query(_COMM_VRE + " SELECT country, round(d3, 6) AS datein, round(d3, 6) AS dateretrofit, fueltype, technology, round(sum(capacity), 6) AS capacity, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, 'PP' AS \"set\"" + _BY)
def vre_cohorts_mean(spark, sf):
    return _cohorts(spark, sf, "mean")


@query(_COMM_VRE + " SELECT country, round(d3, 6) AS datein, round(d3, 6) AS dateretrofit, fueltype, technology, round(sum(capacity), 6) AS capacity, " + ", ".join(f"round(sum({c} * capacity) FILTER (lat IS NOT NULL AND lon IS NOT NULL) / nullif(sum(capacity) FILTER (lat IS NOT NULL AND lon IS NOT NULL), 0), 4) AS {c}" for c in ("lat", "lon")) + ", 'PP' AS \"set\"" + _BY)
def vre_cohorts_weighted(spark, sf):
    return _cohorts(spark, sf, "wm")


@query()
def vintage_cohorts(spark, sf):
    from regfuse.operators.heuristics import vintage_cohorts as cohorts

    p = plants(spark, sf).filter("DateIn between 1850 and 2035 and Capacity > 0 and Capacity < 99999")
    yearly = p.groupBy("Country", "Fueltype", F.col("DateIn").alias("Year")).agg(F.sum("Capacity").alias("Capacity"))
    return lower(cohorts(yearly)).withColumns(r6("capacity"))


_BUSES = "b AS (SELECT bus, x, y, country AS bc FROM buses WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))"


@query("{P}, " + _BUSES + ", d AS (SELECT row_id, arg_min(bus, ((x - lon) * (x - lon) + (y - lat) * (y - lat), bus)) AS bus FROM p, b WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY row_id) SELECT row_id, bus FROM p LEFT JOIN d USING (row_id)")
def nearest_bus(spark, sf):
    from regfuse.operators.export import nearest_bus as nearest

    return nearest(plants(spark, sf).select("row_id", "lat", "lon"), table(spark, sf, "buses")).select("row_id", "bus")


@query("{P}, " + _BUSES + ", d AS (SELECT row_id, arg_min(bus, ((x - lon) * (x - lon) + (y - lat) * (y - lat), bus)) AS bus FROM p JOIN b ON bc = country WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY row_id) SELECT row_id, bus FROM p LEFT JOIN d USING (row_id)")
def nearest_country_bus(spark, sf):
    from regfuse.operators.export import nearest_bus as nearest

    return nearest(plants(spark, sf).select("row_id", "lat", "lon", "Country"), table(spark, sf, "buses"), by_country=True).select("row_id", "bus")


@query("""{P} SELECT country AS bus, lower(fueltype) AS carrier, c AS component, round(coalesce(sum(capacity), 0), 6) AS p_nom, round(coalesce(sum(duration * capacity), 0) / nullif(sum(capacity), 0), 6) AS max_hours FROM (SELECT *, CASE WHEN "set" = 'CHP' THEN 'PP' ELSE "set" END AS c FROM p) WHERE country IS NOT NULL AND fueltype IS NOT NULL AND c IS NOT NULL GROUP BY country, fueltype, c""")
def network_agg(spark, sf):
    from regfuse.operators.export import network_parts

    stores, others = network_parts(plants(spark, sf).withColumn("bus", F.col("Country")))
    return lower(stores.unionByName(others).select("bus", "carrier", "component", F.round("p_nom", 6).alias("p_nom"), F.round("max_hours", 6).alias("max_hours")))


@query("""{P}, y AS (SELECT * FROM (VALUES (2015), (2020), (2025), (2030)) v(year)), t AS (SELECT * FROM (VALUES ('Hydro', 100), ('Wind', 25), ('Solar', 25)) v(fueltype, life))
SELECT year, fueltype, country, round(sum(capacity), 3) AS capacity FROM p JOIN t USING (fueltype), y WHERE datein IS NOT NULL AND country IS NOT NULL AND datein <= year AND coalesce(coalesce(dateout, greatest(datein, dateretrofit) + life) > year, true) GROUP BY ALL""")
def stock_by_year(spark, sf):
    from regfuse.operators.export import stock_by_year as stock

    return lower(stock(plants(spark, sf).filter(F.col("Fueltype").isin("Hydro", "Wind", "Solar")), {"Hydro": 100, "Wind": 25, "Solar": 25}, 2015, 2030))


@query(_MATCHED + " SELECT match_id FROM m WHERE projectid = (SELECT min(projectid) FROM m) GROUP BY match_id")
def select_by_project_id(spark, sf):
    from regfuse.operators.fuse import reduce_matched
    from regfuse.operators.fuse import select_by_project_id as select

    m = _matched(spark, sf)
    one = m.agg(F.min("projectID").alias("v")).collect()[0].v
    return select(reduce_matched(m, _trust(spark, sf)), one or "").select("match_id")


@query("""{P}, u AS (SELECT projectid, len(list_filter(string_split(projectid, ','), lambda x: trim(x) <> '')) AS n, unnest(list_filter(string_split(projectid, ','), lambda x: trim(x) <> '')) AS id, storagecapacity_mwh AS v FROM p WHERE storagecapacity_mwh IS NOT NULL)
SELECT trim(id) AS projectid, round(sum(v / n), 6) AS storagecapacity FROM u GROUP BY trim(id)""")
def apportion_storage(spark, sf):
    from regfuse.sources.importers import apportion_storage as apportion

    p = plants(spark, sf).filter("StorageCapacity_MWh is not null")
    ids = p.select(F.explode(F.filter(F.transform(F.split("projectID", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("projectID")).distinct()
    return lower(apportion(p, ids, "StorageCapacity_MWh", "projectID").withColumns(r6("StorageCapacity")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def json_flatten(spark, sf):
    from regfuse.sources.readers import flatten

    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(e)


@query("{P} SELECT source, country, fueltype, \"set\", round(sum(capacity), 3) AS capacity FROM p WHERE source IS NOT NULL AND country IS NOT NULL AND fueltype IS NOT NULL AND \"set\" IS NOT NULL GROUP BY ALL")
def group_all_keys(spark, sf):
    from regfuse.operators.aggregate import group_all_other

    return lower(group_all_other(plants(spark, sf).select("source", "Country", "Fueltype", "Set", "Capacity"), "Capacity").withColumn("Capacity", F.round("Capacity", 3)))


@query("{P} SELECT row_id FROM p WHERE (fueltype, technology) IN (SELECT (fueltype, technology) FROM p WHERE fueltype IS NOT NULL AND technology IS NOT NULL GROUP BY fueltype, technology HAVING count(*) >= 10)")
def having_size(spark, sf):
    from regfuse.operators.aggregate import at_least

    return at_least(plants(spark, sf).dropna(subset=["Fueltype", "Technology"]), ["Fueltype", "Technology"], 10).select("row_id")


@query("{P} SELECT fueltype, count(efficiency) AS present, count(*) FILTER (efficiency IS NULL) AS missing FROM p GROUP BY fueltype")
def null_counts(spark, sf):
    from regfuse.operators.aggregate import null_counts as counts

    return lower(counts(plants(spark, sf), "Fueltype", "Efficiency"))


@query("{P} SELECT row_id FROM p WHERE coalesce(datein <= 2015, true) AND coalesce(dateout >= 2015, true)")
def active_in_year(spark, sf):
    from regfuse.operators.export import active_in

    return active_in(plants(spark, sf), 2015).select("row_id")


@query("""{P}, o AS (SELECT country, sum(capacity) AS own FROM p WHERE source = 'GEOLIST' AND country IS NOT NULL GROUP BY country), s AS (SELECT country, sum(capacity) AS stated FROM p WHERE source = 'MARKTREG' AND country IS NOT NULL GROUP BY country)
SELECT country, round(coalesce(own, 0), 3) AS own, round(coalesce(stated, 0), 3) AS stated, round(greatest(least(coalesce(own, 0) - coalesce(stated, 0), 1000), -1000), 3) AS difference, round(coalesce(own, 0) / nullif(coalesce(stated, 0), 0), 6) AS share FROM o FULL JOIN s USING (country)""")
def coverage_diff(spark, sf):
    from regfuse.operators.export import coverage

    p = plants(spark, sf)
    return lower(coverage(p.filter("source = 'GEOLIST'"), p.filter("source = 'MARKTREG'"), ["Country"]))


@query("{P} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(name, '[ \\t\\n\\r]+')) AS word FROM p) WHERE word <> '' GROUP BY word HAVING count(*) >= 20".replace("\\\\", "\\"))
def common_words(spark, sf):
    from regfuse.operators.aggregate import common_words as words

    return words(plants(spark, sf))


@query("{P} SELECT row_id, fueltype FROM (SELECT row_id, CASE WHEN fueltype IN ('Mixed fuel types', 'Electro-mechanical') THEN 'Other' ELSE coalesce(fueltype, 'Other') END AS fueltype FROM p)")
def uncommon_to_other(spark, sf):
    from regfuse.operators.heuristics import uncommon_fuels_to_other

    return lower(uncommon_fuels_to_other(plants(spark, sf)).select("row_id", "Fueltype"))


@query("{P}, n AS (SELECT *, CASE WHEN contains(lower(name), 'fellinggard') OR contains(lower(name), 'jetsmark') THEN 'DKW' WHEN contains(lower(name), 'jegerspris') THEN 'DKE' END AS r FROM p), d AS (SELECT row_id, unnest(CASE WHEN r IS NOT NULL THEN [r] WHEN lon IS NULL THEN ['DKE', 'DKW'] WHEN lon >= 10.96 THEN ['DKE'] ELSE ['DKW'] END) AS region, CASE WHEN r IS NULL AND lon IS NULL THEN capacity / 2 ELSE capacity END AS capacity FROM n WHERE country = 'Denmark' OR r IS NOT NULL) SELECT row_id, region, capacity FROM d")
def denmark_regions(spark, sf):
    from regfuse.operators.heuristics import denmark_regions as regions

    return lower(regions(plants(spark, sf)).filter("Region is not null").select("row_id", "Region", "Capacity"))


@query("{P} SELECT row_id FROM p WHERE coalesce(lat BETWEEN 47 AND 55 AND lon BETWEEN 5 AND 16, true)")
def bounding_box(spark, sf):
    from regfuse.operators.heuristics import bounding_box as box

    return box(plants(spark, sf), 47, 55, 5, 16).select("row_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, sf):
    from regfuse.streaming.events import hourly_totals

    return hourly_totals(table(spark, sf, "events"))


@query("""{P} SELECT fueltype, round(quantile_cont(capacity, 0.5), 6) AS median, round(avg(capacity), 6) AS mean, count(capacity) AS n FROM p WHERE fueltype IS NOT NULL GROUP BY fueltype""")
def capacity_distribution(spark, sf):
    p = plants(spark, sf).filter("Fueltype is not null")
    return lower(p.groupBy("Fueltype").agg(F.round(F.percentile("Capacity", F.lit(0.5)), 6).alias("median"), F.round(F.avg("Capacity"), 6).alias("mean"), F.count("Capacity").alias("n")))


_SHORT = "('Solid Biomass', 'BIO'), ('Biogas', 'BIG'), ('Geothermal', 'GEO'), ('Hard Coal', 'COA'), ('Hydro', 'HYD'), ('Lignite', 'LIG'), ('Natural Gas', 'NG'), ('Nuclear', 'NUC'), ('Oil', 'OIL'), ('Other', 'OTH'), ('Solar', ''), ('Waste', 'WST'), ('Wind', 'WO')"


@query("{P}, s AS (SELECT * FROM (VALUES " + _SHORT + """) v(fueltype, short)), t AS (SELECT row_id, CASE WHEN "set" LIKE '%CHP%' THEN 'ConELC-CHP_' ELSE 'ConELC-PP_' END || short || CASE
 WHEN fueltype = 'Wind' THEN CASE WHEN technology ILIKE '%offshore%' THEN 'F' ELSE 'N' END WHEN fueltype = 'Solar' THEN CASE WHEN technology ILIKE '%csp%' THEN 'CSP' ELSE 'SPV' END
 WHEN fueltype = 'Natural Gas' THEN CASE WHEN technology ILIKE '%ccgt%' THEN '-CCGT' WHEN technology ILIKE '%ocgt%' THEN '-OCGT' ELSE '-ST' END
 WHEN fueltype = 'Hydro' THEN CASE WHEN technology ILIKE '%pumped storage%' THEN '-PST' WHEN technology ILIKE '%run-of-river%' THEN '-ROR' ELSE '-STO' END ELSE '' END AS timestype FROM p JOIN s USING (fueltype))
SELECT row_id, timestype FROM t""")
def times_types(spark, sf):
    from regfuse.operators.export import times_types as types

    return lower(types(plants(spark, sf)).filter("TimesType is not null").select("row_id", "TimesType"))


@query()
def times_stock(spark, sf):
    from regfuse.operators.export import times_stock as stock

    return lower(stock(plants(spark, sf)).withColumn("Capacity", F.round("Capacity", 3)))


@query("{P} SELECT row_id FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL")
def geo_presence(spark, sf):
    from regfuse.operators.heuristics import with_position

    return with_position(plants(spark, sf)).select("row_id")


def _fused(spark, sf):
    from regfuse.collection import powerplants
    from regfuse.config import get_config

    p = plants(spark, sf).withColumnRenamed("row_id", "id")
    trust = _trust(spark, sf)
    config = get_config(matching_sources={s: None for s in sorted(trust)}, fully_included_sources={"GEOLIST": "Capacity >= 1", "MARKTREG": None}, reliability=trust)
    return powerplants({s: p.filter(F.col("source") == s).drop("source") for s in sorted(trust)}, config)


@query()
def powerplants_fused(spark, sf):
    """All registers aggregated, linked, fused and extended."""
    return lower(_fused(spark, sf).select("Name", "Fueltype", "Technology", "Set", "Country", "Capacity", "DateIn", "lat", "lon", "projectID"))
