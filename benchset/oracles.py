"""The same queries in SQL for DuckDB, written from their meaning, not from the plans.

Spatial joins are plain theta joins here, ranks are windows over whole tables
and medians are built in, so that an error in a scalable plan shows.
"""

from __future__ import annotations

import re

from benchset import adapters as A
from benchset.registry import AGREEMENT_YEAR, plain_name
from wardscore.functions import codes, projection as P
from wardscore.plans import incidents as I
from wardscore.plans import water as W
from wardscore.plans.combine import OVERALL, QUALITY_COLUMNS
from wardscore.plans.dashboard import METRICS
from wardscore.plans.rollup import AVERAGED, SUMMED
from wardscore.streaming.incident_medians import MEDIAN_BUCKETS

CTES: dict[str, str] = {}


def r6(expr: str) -> str:
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0e0 ELSE round({expr}, 6) END)"


def q(name: str) -> str:
    return f'"{name}"'


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list) -> str:
    return "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


def case(key: str, book: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in book.items())
    return f"CASE {key} {arms} ELSE {default} END"


def row_mean(columns: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0e0)" for c in columns)
    present = " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)
    return f"(({total}) / nullif({present}, 0))"


def z(c: str) -> str:
    return f"(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-12))"


def quality(c: str, higher: bool) -> str:
    lo, hi = f"min({c}) OVER ()", f"max({c}) OVER ()"
    share = f"({c} - {lo}) / ({hi} - {lo})"
    value = share if higher else f"1e0 - {share}"
    return f"CASE WHEN {lo} IS NULL OR {hi} = {lo} THEN 50e0 ELSE ({value}) * 100e0 END"


def rank(score: str, key: str, descending: bool) -> str:
    return f"row_number() OVER (ORDER BY round({score}, 9) {'DESC' if descending else 'ASC'} NULLS LAST, {key})"


def segment(place: str = "rank") -> str:
    k = "least(10, (count(*) OVER ()) // 2)"
    return f"CASE WHEN {place} <= {k} THEN 'Top' WHEN {place} > (count(*) OVER ()) - {k} THEN 'Bottom' ELSE 'Middle' END"


# Inputs

CTES["readings"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'NO2' WHEN 'N' THEN 'PM2.5' ELSE 'O3' END AS pollutant,
       CAST(l_suppkey AS VARCHAR) AS geo, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS value
FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey % 101 <> 0"""

CTES["samples"] = """
SELECT CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE ' ' END AS site,
       CASE l_returnflag WHEN 'N' THEN 'Operational' ELSE 'Compliance' END AS class,
       l_discount AS m0, l_tax AS m1, l_quantity AS m2,
       CASE l_linenumber WHEN 1 THEN 0.5e0 ELSE CAST(l_linenumber AS DOUBLE) END AS m3,
       CASE l_linenumber % 3 WHEN 0 THEN 0.5e0 WHEN 2 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS m4
FROM lineitem"""


def places(key: str) -> str:
    return (
        f"CASE WHEN {key} % 13 = 0 THEN NULL ELSE 890000 + ({key} * 31337 + copy * 5000) % 220000 END AS x, "
        f"100000 + ({key} * 65537 + copy * 5000) % 200000 AS y"
    )


CTES["site_rows"] = f"""
SELECT p_partkey * 2 + copy AS row_no, CAST(p_partkey AS VARCHAR) AS site, p_name AS place, {places('p_partkey')}
FROM (SELECT *, unnest(CASE WHEN p_partkey % 10 = 3 THEN [1, 0] ELSE [0] END) AS copy FROM part)"""

CTES["school_rows"] = f"""
SELECT c_custkey * 2 + copy AS row_no, 'BN' || CAST(c_custkey AS VARCHAR) AS bn, c_name AS place,
       c_mktsegment AS category, {places('c_custkey')}
FROM (SELECT *, unnest(CASE WHEN c_custkey % 10 = 3 THEN [1, 0] ELSE [0] END) AS copy FROM customer)"""


def review_code(factor: int) -> str:
    number = f"(o_orderkey * {factor} + o_orderkey // {factor}) % 9"
    # U and UD are one code; blanks and case do not count; 'No Data' is no code.
    texts = ["U/UD", "U/UD", "UPF", "D", "P", "WD", "O", None, "XX"]
    arms = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts) if t)
    return f"CASE {number} {arms} END"


CTES["review_codes"] = f"""
SELECT CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE 'BN' || CAST(o_custkey AS VARCHAR) END AS bn,
       CAST(year(o_orderdate) AS INT) AS yr,
       {', '.join(f'{review_code(f)} AS c{i}' for i, f in enumerate([*A.RATING_FACTORS, A.OVERALL_FACTOR]))}
FROM orders WHERE o_orderkey % 211 <> 0 OR o_orderkey % 307 = 0"""

CTES["reviews"] = f"""
SELECT *, {row_mean([f'v{i}' for i in range(5)])} AS rating,
       ({' + '.join(f'(v{i} IS NOT NULL)::INT' for i in range(5))}) / 5e0 AS completeness
FROM (SELECT bn, yr, {', '.join(f"CAST({case(f'c{i}', codes.RATING_SCALE)} AS DOUBLE) AS v{i}" for i in range(6))}
      FROM review_codes)"""

CTES["incidents"] = """
SELECT event_id, CASE WHEN event_id % 37 <> 0 THEN CAST(event_id AS VARCHAR) END AS cmplnt_num,
  CASE user_id % 6 WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'BROOKLYN' WHEN 3 THEN 'QUEENS'
       WHEN 4 THEN 'STATEN ISLAND' ELSE 'UNKNOWN' END AS boro,
  CASE WHEN event_id % 50 IN (0, 1) THEN '0' ELSE CAST(1 + user_id % 40 AS VARCHAR) END AS pct,
  CASE event_type WHEN 'error' THEN 5e0 WHEN 'purchase' THEN 3e0 WHEN 'click' THEN 3e0 ELSE 1e0 END AS law,
  CASE event_id % 4 WHEN 0 THEN 0.7e0 ELSE 1e0 END AS factor,
  CASE event_id % 7 WHEN 0 THEN 5e0 WHEN 1 THEN 4e0 WHEN 2 THEN 3e0 WHEN 3 THEN 2e0 WHEN 4 THEN 2e0 END AS floor_last,
  CASE event_id % 7 WHEN 0 THEN 5e0 WHEN 1 THEN 4e0 WHEN 2 THEN 3e0 WHEN 3 THEN 2e0 WHEN 4 THEN 5e0 END AS floor_max,
  890000 + (event_id * 31337) % 220000 AS raw_x, 100000 + (event_id * 65537) % 200000 AS raw_y,
  CASE WHEN event_id % 97 <> 0 THEN 40.40e0 + CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.60e0 END AS raw_lat,
  -74.35e0 + CAST((event_id * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.75e0 AS raw_lon,
  event_type, user_id
FROM events"""

CTES["clean"] = """
SELECT *, boro || '-PCT-' || pct AS unit, greatest(law, floor_last) AS sev, greatest(law, floor_last) * factor AS weighted,
  CASE WHEN raw_x BETWEEN 900000 AND 1100000 THEN CAST(raw_x AS DOUBLE) END AS x,
  CASE WHEN raw_y BETWEEN 110000 AND 280000 THEN CAST(raw_y AS DOUBLE) END AS y,
  CASE WHEN raw_lat BETWEEN 40.45e0 AND 40.95e0 THEN raw_lat END AS lat,
  CASE WHEN raw_lon BETWEEN -74.30e0 AND -73.65e0 THEN raw_lon END AS lon,
  (raw_x BETWEEN 900000 AND 1100000 AND raw_y BETWEEN 110000 AND 280000
   AND coalesce(raw_lat BETWEEN 40.45e0 AND 40.95e0, FALSE) AND raw_lon BETWEEN -74.30e0 AND -73.65e0) AS valid
FROM incidents"""


# Polygons: corners of every outline, then edges per tile


def corners(names: list[str], shape_names: list[str]) -> str:
    rows = []
    for shape in names:
        for p, rings in enumerate(A.OUTLINES[shape]):
            for r, ring in enumerate(rings):
                # Without the repeated first corner.
                open_ring = ring[:-1] if ring[0] == ring[-1] else ring
                rows += [f"({quoted(shape)}, {p}, {r}, {i}, {c[0]}, {c[1]})" for i, c in enumerate(open_ring)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(shape, part, ring, seq, a, b)"


CTES["corner"] = corners(list(A.OUTLINES), [])


def vertices(source: str, key: str, outlines: list[str], extent: tuple) -> str:
    west, south, width, height = (f"{v!r}e0" for v in extent)
    kinds = " ".join(f"WHEN {i} THEN {quoted(o)}" for i, o in enumerate(outlines))
    return f"""
SELECT k, CAST(k AS VARCHAR) AS zone_id, part, ring, seq,
       {west} + {width} * CAST((k % side) * 8 + a AS DOUBLE) / CAST(8 * side AS DOUBLE) AS x,
       {south} + {height} * CAST((k // side) * 8 + b AS DOUBLE) / CAST(8 * side AS DOUBLE) AS y
FROM (SELECT {key} AS k, CASE {key} % {len(outlines)} {kinds} END AS shape,
             (SELECT CAST(ceil(sqrt(max({key}) + 1)) AS BIGINT) FROM {source}) AS side
      FROM {source} WHERE {key} % 23 <> 22 AND {key} % 29 <> 28)
JOIN corner USING (shape)"""


def edges(of: str, x: str = "x", y: str = "y") -> str:
    ring = "PARTITION BY k, part, ring ORDER BY seq"
    return f"""
SELECT k, zone_id, part, ring, {x} AS x1, {y} AS y1,
       coalesce(lead({x}) OVER ({ring}), first_value({x}) OVER ({ring})) AS x2,
       coalesce(lead({y}) OVER ({ring}), first_value({y}) OVER ({ring})) AS y2
FROM {of}"""


def signed(of: str) -> str:
    """Edges with a sign that turns outer rings counter-clockwise, holes clockwise."""
    return f"""
SELECT *, sign(sum(x1 * y2 - x2 * y1) OVER (PARTITION BY k, part, ring)) * CASE ring WHEN 0 THEN 1 ELSE -1 END AS s
FROM {of}"""


def plane_x_y(lon: str, lat: str) -> tuple[str, str]:
    t = f"(tan(pi() / 4 - radians({lat}) / 2) * exp({P.ECC!r}e0 * atanh({P.ECC!r}e0 * sin(radians({lat})))))"
    rho = f"({P.SCALE!r}e0 * pow({t}, {P.CONE!r}e0))"
    theta = f"((radians({lon}) - {P.LONGITUDE_0!r}e0) * {P.CONE!r}e0)"
    x = f"({P.FALSE_EASTING!r}e0 + {rho} * sin({theta})) / {P.METRES_PER_FOOT!r}e0"
    y = f"({P.RHO_0!r}e0 - {rho} * cos({theta})) / {P.METRES_PER_FOOT!r}e0"
    return x.replace("e0e0", "e0"), y


def lon_lat(x: str, y: str) -> tuple[str, str]:
    east = f"({x} * {P.METRES_PER_FOOT!r}e0 - {P.FALSE_EASTING!r}e0)"
    north = f"({P.RHO_0!r}e0 - {y} * {P.METRES_PER_FOOT!r}e0)"
    t = f"pow(sqrt({east} * {east} + {north} * {north}) / {P.SCALE!r}e0, {1 / P.CONE!r}e0)"
    phi = f"(pi() / 2 - 2 * atan({t}))"
    for _ in range(P.INVERSE_STEPS):
        phi = f"(pi() / 2 - 2 * atan({t} * exp({-P.ECC!r}e0 * atanh({P.ECC!r}e0 * sin({phi})))))"
    return f"degrees(atan2({east}, {north}) / {P.CONE!r}e0 + {P.LONGITUDE_0!r}e0)", f"degrees({phi})"


CTES["va"] = vertices("supplier", "s_suppkey", A.DISTRICT_OUTLINES, A.DISTRICT_EXTENT)
CTES["vb"] = vertices("customer", "c_custkey", A.BLOCK_OUTLINES, A.BLOCK_EXTENT)
for side in "ab":
    px, py = plane_x_y("x", "y")
    CTES[f"e{side}"] = edges(f"v{side}")
    CTES[f"p{side}"] = edges(f"(SELECT k, zone_id, part, ring, seq, {px} AS px, {py} AS py FROM v{side})", "px", "py")
    CTES[f"sp{side}"] = signed(f"p{side}")
CTES["sa"] = signed("ea")
CTES["box_a"] = "SELECT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM va GROUP BY k"


def hits(points: str, key: str) -> str:
    """Pairs (key, k) of points (lon, lat) strictly by the even-odd rule."""
    return f"""
SELECT DISTINCT {key}, k FROM (
  SELECT {key}, k, part, bool_and(CASE WHEN ring = 0 THEN inside ELSE NOT inside END) AS in_part
  FROM (SELECT p.{key}, e.k, e.part, e.ring,
          count(*) FILTER ((e.y1 > p.lat) <> (e.y2 > p.lat)
            AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / ((e.y2 - e.y1) + 1e-15) + e.x1) % 2 = 1 AS inside
        FROM {points} p JOIN box_a b ON p.lon BETWEEN b.x0 AND b.x1 AND p.lat BETWEEN b.y0 AND b.y1
        JOIN ea e ON e.k = b.k GROUP BY ALL) GROUP BY ALL) WHERE in_part"""


CTES["box_b"] = "SELECT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vb GROUP BY k"
CTES["event_points"] = "SELECT event_id, raw_lat AS lat, raw_lon AS lon FROM incidents WHERE raw_lat IS NOT NULL"
CTES["event_hits"] = hits("event_points", "event_id")
CTES["block_hits"] = hits("event_points", "event_id").replace("box_a", "box_b").replace("ea e", "eb e")
# Whole billionths of a degree, whose products HUGEINT holds exactly.
X1, Y1, X2, Y2, PX, PY = (f"CAST(round({v} * 1e9) AS HUGEINT)" for v in ("e.x1", "e.y1", "e.x2", "e.y2", "p.lon", "p.lat"))
CTES["edge_points"] = "SELECT DISTINCT (x1 * 2 + x2) / 3 AS lon, (y1 * 2 + y2) / 3 AS lat FROM ea"
CTES["edge_hits"] = f"""
SELECT DISTINCT lon, lat, k FROM (
  SELECT lon, lat, k, part, bool_and(CASE WHEN ring = 0 THEN inside ELSE NOT inside END) AND NOT bool_or(touched) AS hit
  FROM (SELECT p.lon, p.lat, e.k, e.part, e.ring,
          count(*) FILTER ((e.y1 > p.lat) <> (e.y2 > p.lat)
            AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / ((e.y2 - e.y1) + 1e-15) + e.x1) % 2 = 1 AS inside,
          bool_or(({X2} - {X1}) * ({PY} - {Y1}) = ({Y2} - {Y1}) * ({PX} - {X1})
            AND {PX} BETWEEN least({X1}, {X2}) AND greatest({X1}, {X2}) AND {PY} BETWEEN least({Y1}, {Y2}) AND greatest({Y1}, {Y2})) AS touched
        FROM edge_points p JOIN box_a b ON p.lon BETWEEN b.x0 AND b.x1 AND p.lat BETWEEN b.y0 AND b.y1
        JOIN ea e ON e.k = b.k GROUP BY ALL) GROUP BY ALL) WHERE hit"""
CTES["valid_points"] = "SELECT * FROM clean WHERE valid"
CTES["zone_incidents"] = f"""
SELECT c.cmplnt_num, CAST(h.k AS VARCHAR) AS zone_id, 'AREA_' || h.k AS zone_name, c.weighted
FROM ({hits('valid_points', 'event_id')}) h JOIN clean c USING (event_id)"""

cross = "s * (x1 * y2 - x2 * y1)"
centroid_lon, centroid_lat = lon_lat("cx", "cy")
CTES["centroids"] = f"""
SELECT zone_id, {centroid_lat} AS lat, {centroid_lon} AS lon
FROM (SELECT zone_id, sum((x1 + x2) * {cross}) / (3 * sum({cross})) AS cx,
             sum((y1 + y2) * {cross}) / (3 * sum({cross})) AS cy FROM spa GROUP BY zone_id)"""


# Jobs

CTES["air"] = f"""
SELECT *, {rank('airscore', 'geo_join_id', True)} AS rank FROM (
  SELECT *, {row_mean(['z_pm2_5', 'z_no2', 'z_o3'])} AS airscore FROM (
    SELECT *, {z('no2')} AS z_no2, {z('pm2_5')} AS z_pm2_5, {z('o3')} AS z_o3 FROM (
      SELECT geo AS geo_join_id, 'AREA_' || geo AS geo_place_name,
             avg(value) FILTER (pollutant = 'NO2') AS no2, avg(value) FILTER (pollutant = 'PM2.5') AS pm2_5,
             avg(value) FILTER (pollutant = 'O3') AS o3
      FROM readings GROUP BY geo)))"""


def water(where: str) -> str:
    m = [plain_name(c) for c in W.MEASURES]
    means = ", ".join(f"avg(m{i}) AS {c}" for i, c in enumerate(m))
    return f"""
SELECT *, {rank('waterscore', 'site', False)} AS rank FROM (
  SELECT *, {row_mean([f'z_{c}' for c in m])} AS waterscore FROM (
    SELECT *, {', '.join(f'{z(c)} AS z_{c}' for c in m)} FROM (SELECT site, {means} FROM samples {where} GROUP BY site)))"""


CTES["water"] = water("WHERE class = 'Compliance'")
CTES["water_all"] = water("")
site_lon, site_lat = lon_lat("x", "y")
CTES["sites"] = f"""
SELECT site, place, x, y, {site_lon} AS lon, {site_lat} AS lat
FROM (SELECT * FROM site_rows QUALIFY row_number() OVER (PARTITION BY site ORDER BY row_no) = 1)"""
CTES["schools"] = f"""
SELECT bn, place, category, x, y, {site_lon} AS lon, {site_lat} AS lat
FROM (SELECT * FROM school_rows QUALIFY row_number() OVER (PARTITION BY bn ORDER BY row_no) = 1)"""

CTES["grades"] = """
SELECT bn, CASE WHEN rated > 0 THEN grade END AS grade, CASE WHEN rated > 0 THEN completeness END AS completeness,
       CASE WHEN rated > 0 THEN n ELSE 0 END AS n, CASE WHEN rated > 0 THEN first_year END AS first_year,
       CASE WHEN rated > 0 THEN last_year END AS last_year
FROM (SELECT bn, count(rating) AS rated,
             sum(rating * pow(0.9e0, top - yr)) / sum(CASE WHEN rating IS NOT NULL THEN pow(0.9e0, top - yr) END) AS grade,
             avg(completeness) AS completeness, count(*) AS n, min(yr) AS first_year, max(yr) AS last_year
      FROM reviews, (SELECT max(yr) AS top FROM reviews) WHERE bn IS NOT NULL GROUP BY bn)"""


def units(key: str) -> str:
    return f"""
SELECT *, -burden_z AS safety, {rank('(-burden_z)', 'geo_unit', True)} AS rank FROM (
  SELECT *, {z('weighted_severity_sum')} AS burden_z FROM (
    SELECT {key} AS geo_unit, count(*) AS incident_count, sum(weighted) AS weighted_severity_sum,
           count(*) FILTER (valid) AS valid_point_count, count(*) FILTER (valid) / count(*) AS point_coverage_rate,
           median(x) AS representative_x, median(y) AS representative_y,
           median(lat) AS representative_latitude, median(lon) AS representative_longitude
    FROM clean GROUP BY {key}))"""


CTES["units"] = units("unit")
CTES["boroughs"] = units("boro")


def middle(c: str, name: str) -> str:
    """A value moved to the middle of its bucket."""
    low, high = (f"{v!r}e0" for v in I.COORDINATE_BOUNDS[name])
    step = f"(({high} - {low}) / {MEDIAN_BUCKETS}e0)"
    return f"CASE WHEN {c} IS NOT NULL THEN {low} + (least(floor(({c} - {low}) / {step}), {MEDIAN_BUCKETS - 1}) + 0.5e0) * {step} END"


CTES["bucketed_units"] = f"""
SELECT unit AS geo_unit, count(*) AS incident_count, sum(weighted) AS weighted_severity_sum, count(*) FILTER (valid) AS valid_point_count,
       median({middle('x', 'X_COORD_CD')}) AS representative_x, median({middle('y', 'Y_COORD_CD')}) AS representative_y,
       median({middle('lat', 'Latitude')}) AS representative_latitude, median({middle('lon', 'Longitude')}) AS representative_longitude,
       round(count(*) FILTER (valid) / count(*), 6) AS point_coverage_rate
FROM clean GROUP BY unit"""

CTES["zone_safety"] = f"""
SELECT *, -burden_z AS safety, {rank('(-burden_z)', 'zone_id', True)} AS rank FROM (
  SELECT *, {z('severity_sum')} AS burden_z FROM (
    SELECT zone_id, min(zone_name) AS zone_name, count(cmplnt_num) AS n, sum(weighted) AS severity_sum
    FROM zone_incidents GROUP BY zone_id) JOIN centroids USING (zone_id))"""


def zone_quality(points: str, key: str, score: str, higher: bool) -> str:
    return f"""
SELECT *, {rank('quality', 'zone_id', True)} AS rank FROM (
  SELECT *, {quality('score', higher)} AS quality FROM (
    SELECT CAST(k AS VARCHAR) AS zone_id, count(*) AS n, avg({score}) AS score,
           median(lat) AS lat, median(lon) AS lon
    FROM (SELECT {key}, min(k) AS k FROM ({hits(points, key)}) GROUP BY {key}) JOIN {points} USING ({key})
    GROUP BY k))"""


CTES["water_points"] = """
SELECT w.site, waterscore AS score, lat, lon
FROM water w JOIN sites s ON trim(w.site) = s.site WHERE lat IS NOT NULL AND lon IS NOT NULL AND waterscore IS NOT NULL"""
CTES["school_points"] = """
SELECT bn, grade AS score, lat, lon
FROM grades JOIN schools USING (bn) WHERE lat IS NOT NULL AND lon IS NOT NULL AND grade IS NOT NULL"""
CTES["water_zones"] = zone_quality("water_points", "site", "score", False)
CTES["school_zones"] = zone_quality("school_points", "bn", "score", True)

# Area two signed edges' trapezoids share, over their common x-range [l, r].
at_l = "({0}y1 + ({0}y2 - {0}y1) * ((l - {0}x1) / ({0}x2 - {0}x1)))"
at_r = "({0}y1 + ({0}y2 - {0}y1) * ((r - {0}x1) / ({0}x2 - {0}x1)))"
CTES["shape_a"] = "SELECT zone_id, sum(s * (x1 * y2 - x2 * y1)) / 2 AS area, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM spa GROUP BY zone_id"
CTES["shape_b"] = CTES["shape_a"].replace("spa", "spb")


def pieces(target_edges: str, target_shapes: str) -> str:
    """Overlaps of the districts with another layer."""
    return f"""
SELECT source_id, target_id, source_area, target_area, inter, inter / target_area AS weight, inter / source_area AS share
FROM (
  SELECT source_id, target_id, any_value(sa.area) AS source_area, any_value(ta.area) AS target_area, any_value(inter) AS inter
  FROM (
    SELECT source_id, target_id, sum(sg * (r - l) * CASE WHEN (a1 - b1) * (a2 - b2) >= 0
             THEN (least(a1, b1) + least(a2, b2)) / 2
             ELSE ((least(a1, b1) + m) * t + (m + least(a2, b2)) * (1 - t)) / 2 END) AS inter
    FROM (SELECT *, a1 + t * (a2 - a1) AS m FROM (
      SELECT *, (a1 - b1) / nullif((a1 - b1) - (a2 - b2), 0) AS t FROM (
        SELECT source_id, target_id, sg, l, r, {at_l.format('a')} - base AS a1, {at_r.format('a')} - base AS a2,
               {at_l.format('b')} - base AS b1, {at_r.format('b')} - base AS b2
        FROM (SELECT a.zone_id AS source_id, b.zone_id AS target_id,
                     a.s * sign(a.x1 - a.x2) * b.s * sign(b.x1 - b.x2) AS sg,
                     greatest(least(a.x1, a.x2), least(b.x1, b.x2)) AS l,
                     least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) AS r, least(sa.by0, sb.by0) AS base,
                     a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
              FROM shape_a sa JOIN {target_shapes} sb ON sa.bx0 < sb.bx1 AND sb.bx0 < sa.bx1 AND sa.by0 < sb.by1 AND sb.by0 < sa.by1
              JOIN spa a ON a.zone_id = sa.zone_id JOIN {target_edges} b ON b.zone_id = sb.zone_id
              WHERE a.x1 <> a.x2 AND b.x1 <> b.x2)
        WHERE l < r)))
    GROUP BY source_id, target_id) i
  JOIN shape_a sa ON sa.zone_id = source_id JOIN {target_shapes} ta ON ta.zone_id = target_id
  GROUP BY source_id, target_id)
WHERE inter > 1e-9 * least(source_area, target_area)"""


BOROUGH = case("zone_id[1]", codes.BOROUGH_BY_DIGIT, "'Unknown'")
# All outlines run along the sides and diagonals of unit cells, so four triangles a cell tell exactly what is covered.
width, height = f"({A.DISTRICT_EXTENT[2]!r}e0 / (8 * side))", f"({A.DISTRICT_EXTENT[3]!r}e0 / (8 * side))"
CTES["shape_edge"] = """
SELECT shape, part, ring, a AS x1, b AS y1, coalesce(lead(a) OVER w, first_value(a) OVER w) AS x2, coalesce(lead(b) OVER w, first_value(b) OVER w) AS y2
FROM corner WINDOW w AS (PARTITION BY shape, part, ring ORDER BY seq)"""
CTES["triangle"] = """
SELECT DISTINCT shape, i, j, q FROM (
  SELECT shape, part, i, j, q, bool_and(CASE WHEN ring = 0 THEN inside ELSE NOT inside END) AS hit FROM (
    SELECT shape, part, ring, i, j, q,
           count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside
    FROM shape_edge, (SELECT i, j, q, i + dx AS x, j + dy AS y FROM range(12) AS a(i), range(8) AS b(j),
                      (VALUES (0, 0.5e0, 0.125e0), (1, 0.875e0, 0.5e0), (2, 0.5e0, 0.875e0), (3, 0.125e0, 0.5e0)) AS t(q, dx, dy))
    GROUP BY ALL) GROUP BY ALL) WHERE hit"""
CTES["borough_triangle"] = f"""
SELECT DISTINCT {BOROUGH} AS borough, side, (k % side) * 8 + i AS gi, (k // side) * 8 + j AS gj, q
FROM (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS zone_id,
             CASE s_suppkey % {len(A.DISTRICT_OUTLINES)} {' '.join(f"WHEN {i} THEN {quoted(o)}" for i, o in enumerate(A.DISTRICT_OUTLINES))} END AS shape,
             (SELECT CAST(ceil(sqrt(max(s_suppkey) + 1)) AS BIGINT) FROM supplier) AS side
      FROM supplier WHERE s_suppkey % 23 <> 22 AND s_suppkey % 29 <> 28) JOIN triangle USING (shape)"""
CTES["borough_side"] = f"""
SELECT t.borough, CASE WHEN t.q % 2 = 0 THEN {width} ELSE {height} END AS length
FROM borough_triangle t, (VALUES (0, 0, -1, 2), (1, 1, 0, 3), (2, 0, 1, 0), (3, -1, 0, 1)) AS o(q, di, dj, other)
WHERE o.q = t.q AND NOT EXISTS (SELECT 1 FROM borough_triangle u WHERE u.borough = t.borough AND u.gi = t.gi + o.di AND u.gj = t.gj + o.dj AND u.q = o.other)
UNION ALL
SELECT t.borough, sqrt({width} * {width} + {height} * {height}) / 2 FROM borough_triangle t, (VALUES (1), (3)) AS o(turn)
WHERE NOT EXISTS (SELECT 1 FROM borough_triangle u WHERE u.borough = t.borough AND u.gi = t.gi AND u.gj = t.gj AND u.q = (t.q + o.turn) % 4)"""
CTES["pieces"] = pieces("spb", "shape_b")
# Boroughs are sums over their districts as targets.
CTES["own_pieces"] = pieces("spa", "shape_a")
CTES["borough_area"] = f"SELECT {BOROUGH} AS borough, sum(area) AS area FROM shape_a GROUP BY 1"
CTES["borough_pieces"] = f"""
SELECT source_id, borough AS target_id, sum(inter) / any_value(area) AS weight
FROM (SELECT *, {BOROUGH.replace('zone_id', 'target_id')} AS borough FROM own_pieces) JOIN borough_area USING (borough)
GROUP BY source_id, borough"""

area_columns = """
avg(l_quantity) AS air, avg(l_quantity) FILTER (l_returnflag = 'A') AS no2, avg(l_quantity) FILTER (l_returnflag = 'R') AS o3,
avg(l_quantity) FILTER (l_returnflag = 'N') AS pm2_5, avg(l_extendedprice) AS price, count(*) AS incident_count,
sum(l_discount * 1.3717e0) AS weighted_severity_sum, avg(l_tax) AS tax, count(*) FILTER (l_linenumber = 1) AS water_point_count,
avg(l_discount) AS discount, count(*) FILTER (l_linenumber = 2) AS education_point_count"""
METRIC_NAMES = [plain_name(c) for c in QUALITY_COLUMNS]
CTES["idx"] = f"""
SELECT *, {rank('overall_qualityscore', 'community_district_id', True)} AS overall_rank,
       greatest({', '.join(METRIC_NAMES)}) - least({', '.join(METRIC_NAMES)}) AS metric_range,
       {BOROUGH.replace('zone_id', 'community_district_id')} AS borough
FROM (SELECT *, {row_mean(METRIC_NAMES)} AS overall_qualityscore FROM (
  SELECT *, {quality('airscore', False)} AS air_qualityscore, {quality('waterscore', False)} AS water_qualityscore,
         {quality('educationscore', True)} AS education_qualityscore, {quality('safetyscore', True)} AS safety_qualityscore
  FROM (SELECT CAST(k AS VARCHAR) AS community_district_id, 'AREA_' || k AS community_district_name,
               CASE WHEN k % 41 <> 40 THEN air END AS airscore, no2, o3, pm2_5,
               CASE WHEN k % 41 <> 40 THEN -price / 1000 END AS safetyscore, incident_count, weighted_severity_sum,
               CASE WHEN k % 41 <> 40 AND k % 11 <> 3 THEN tax END AS waterscore, water_point_count,
               CASE WHEN k % 41 <> 40 AND k % 7 <> 0 THEN discount END AS educationscore, education_point_count
        FROM (SELECT l_suppkey AS k, {area_columns} FROM lineitem GROUP BY l_suppkey))))"""

CTES["metric_rows"] = " UNION ALL ".join(
    f"SELECT {i} AS metric_no, {quoted(label)} AS metric, community_district_id, community_district_name, {plain_name(c)} AS score FROM idx"
    for i, (label, c) in enumerate(METRICS.items())
)

INDEX_NAMES = [
    "community_district_id", "community_district_name", "airscore", "air_qualityscore", "no2", "o3", "pm2_5",
    "safetyscore", "safety_qualityscore", "incident_count", "weighted_severity_sum", "waterscore",
    "water_qualityscore", "water_point_count", "educationscore", "education_qualityscore",
    "education_point_count", "overall_qualityscore", "overall_rank",
]
WHOLE = {"incident_count", "water_point_count", "education_point_count", "overall_rank"}
TEXT = {"community_district_id", "community_district_name", "borough", "geo_id", "name"}


def listed(names: list[str], whole: set[str] = WHOLE, text: set[str] = TEXT) -> str:
    out = []
    for n in names:
        out.append(n if n in text else f"CAST({n} AS BIGINT) AS {n}" if n in whole else f"{r6(n)} AS {n}")
    return ", ".join(out)


def rolled(piece_table: str, weight: str) -> str:
    averaged, summed = [plain_name(c) for c in AVERAGED], [plain_name(c) for c in SUMMED]
    cols = [f"sum({c} * {weight}) / sum(CASE WHEN {c} IS NOT NULL THEN {weight} END) AS {c}" for c in averaged]
    cols += [f"sum({c} * {weight}) AS {c}" for c in summed]
    return f"""
SELECT *, {rank('overall_qualityscore', 'geo_id', True)} AS overall_rank FROM (
  SELECT *, {row_mean(METRIC_NAMES)} AS overall_qualityscore FROM (
    SELECT target_id AS geo_id, {', '.join(cols)}
    FROM {piece_table} LEFT JOIN idx ON source_id = community_district_id GROUP BY target_id))"""


ROLLED_NAMES = [plain_name(c) for c in [*AVERAGED, *SUMMED]]


def rolled_select(piece_table: str, weight: str, name: str) -> str:
    figures = listed([*ROLLED_NAMES, "overall_qualityscore"], set())
    return f"SELECT geo_id, {name} AS name, {figures}, overall_rank FROM ({rolled(piece_table, weight)})"


z_water = [plain_name(c) for c in W.MEASURES]
water_figures = ", ".join(f"{r6(c)} AS {c}, {r6('z_' + c)} AS z_{c}" for c in z_water)
unit_figures = ", ".join(
    f"{r6(c)} AS {c}"
    for c in ["weighted_severity_sum", "point_coverage_rate", "representative_x", "representative_y",
              "representative_latitude", "representative_longitude"]
)


def units_select(table: str) -> str:
    return (
        f"SELECT geo_unit, incident_count, valid_point_count, {unit_figures}, {r6('burden_z')} AS crimeburden_z, "
        f"{r6('safety')} AS safetyscore, rank, {segment()} AS segment FROM {table}"
    )


def zone_quality_select(table: str, prefix: str, score: str) -> str:
    return (
        f"SELECT zone_id AS community_district_id, n AS {prefix}_point_count, {r6('score')} AS {score}, "
        f"{r6('lat')} AS {prefix}_representative_latitude, {r6('lon')} AS {prefix}_representative_longitude, "
        f"{r6('quality')} AS {prefix}_qualityscore, rank FROM {table}"
    )


def extreme(score: str, n: int, highest: bool, columns: str, side: str) -> str:
    order = f"round({score}, 9) {'DESC' if highest else 'ASC'} NULLS LAST, community_district_id"
    return f"(SELECT {columns}, '{side}' AS side FROM idx ORDER BY {order} LIMIT {n})"


def half_even(c: str, digits: int = 2) -> str:
    return f"(CASE WHEN round_even({c}, {digits}) = 0 THEN 0e0 ELSE round_even({c}, {digits}) END)"


forward_x, forward_y = plane_x_y("lon", "lat")
grade_columns = f"""bn, place AS location_name, {r6('grade')} AS {{grade}}, {r6('completeness')} AS average_completeness_score,
n AS number_of_years, CAST(first_year AS BIGINT) AS earliest_year, CAST(last_year AS BIGINT) AS latest_year,
coalesce(CAST(x AS VARCHAR), CASE WHEN y IS NOT NULL THEN 'N/A' END) AS x_coordinate, CAST(y AS VARCHAR) AS y_coordinate, category AS location_category_description"""
weights_tail = f"{r6('sev')} AS severity_weight, {r6('factor')} AS attempt_factor, {r6('weighted')} AS weighted_incident"

DISTRICT_LABEL = "(CASE WHEN length({0}) >= 3 THEN 'CD ' || {0}[1] || '-' || {0}[2:] ELSE 'CD ' || {0} END)"
BAND = "CASE WHEN {0} IS NULL THEN NULL WHEN floor({0} + 0.5) >= 90 THEN 'Excellent' WHEN floor({0} + 0.5) >= 70 THEN 'Good' WHEN floor({0} + 0.5) >= 50 THEN 'Moderate' WHEN floor({0} + 0.5) >= 30 THEN 'Below Average' ELSE 'Needs Attention' END"
overall_q = plain_name(OVERALL)
top_columns = f"community_district_id, community_district_name, {r6(overall_q)} AS {overall_q}, overall_rank"
balance_columns = f"community_district_name, {r6('metric_range')} AS metric_range, {r6(overall_q)} AS {overall_q}"
compare_list = [("Overall", overall_q), *[(label, plain_name(c)) for label, c in METRICS.items()]]

boro_raw = "CASE user_id % 6 WHEN 0 THEN 'Manhattan ' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'brooklyn' WHEN 3 THEN 'QUEENS' WHEN 4 THEN 'STATEN ISLAND' ELSE '(null)' END"
offense_raw = "CASE event_id % 7 WHEN 0 THEN 'FELONY ASSAULT' WHEN 1 THEN 'Robbery' WHEN 2 THEN 'BURGLARY' WHEN 3 THEN 'GRAND LARCENY' WHEN 4 THEN 'ASSAULT AND LARCENY' WHEN 5 THEN 'HARASSMENT' END"
law_raw = "CASE event_type WHEN 'error' THEN 'FELONY' WHEN 'purchase' THEN 'MISDEMEANOR' WHEN 'signup' THEN 'VIOLATION' WHEN 'click' THEN 'misdemeanor ' ELSE 'OTHER' END"
pct_raw = "CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(1 + user_id % 40 AS VARCHAR) || '.0' END"
attempt_raw = "CASE event_id % 4 WHEN 0 THEN 'ATTEMPTED' WHEN 1 THEN 'completed' WHEN 2 THEN 'COMPLETED' END"

SELECTS: dict[str, str] = {
    "air_means": f"SELECT geo AS geo_join_id, 'AREA_' || geo AS geo_place_name, pollutant, {r6('avg(value)')} AS avg_value FROM readings GROUP BY geo, pollutant",
    "air_pivot": f"SELECT geo_join_id, geo_place_name, {r6('no2')} AS no2, {r6('pm2_5')} AS pm2_5, {r6('o3')} AS o3 FROM air",
    "air_score": f"SELECT geo_join_id, geo_place_name, {', '.join(f'{r6(c)} AS {c}' for c in ('no2', 'pm2_5', 'o3', 'z_no2', 'z_pm2_5', 'z_o3', 'airscore'))}, rank, {segment()} AS segment, 'CD' AS geo_type_name FROM air",
    "water_sites": f"""SELECT trim(w.site) AS sample_site, place AS location_description,
        coalesce(CAST(x AS VARCHAR), CASE WHEN y IS NOT NULL THEN 'N/A' END) AS x_coordinate, CAST(y AS VARCHAR) AS y_coordinate,
        {r6('lat')} AS latitude, {r6('lon')} AS longitude, {water_figures}, {r6('waterscore')} AS waterscore, rank, segment
        FROM (SELECT *, {segment()} AS segment FROM water) w LEFT JOIN sites s ON trim(w.site) = s.site""",
    "water_sites_all_classes": f"SELECT site AS sample_site, {water_figures}, {r6('waterscore')} AS waterscore, rank, {segment()} AS segment FROM water_all",
    "school_grades": f"SELECT {grade_columns.format(grade='final_weighted_grade')} FROM grades LEFT JOIN schools USING (bn)",
    "education": f"SELECT {grade_columns.format(grade='educationscore')}, {r6('lat')} AS latitude, {r6('lon')} AS longitude FROM grades LEFT JOIN schools USING (bn)",
    "rating_audit": " UNION ".join(
        f"SELECT 'IndicatorOverall_{i + 1}' AS column_name, c{i} AS code FROM review_codes WHERE c{i} NOT IN {in_list(list(codes.RATING_SCALE))}"
        for i in range(5)
    ),
    "rating_corr": f"SELECT count(*) AS review_count, {r6('corr(v5, rating)')} AS correlation FROM reviews WHERE yr <= {AGREEMENT_YEAR} AND v5 IS NOT NULL AND rating IS NOT NULL",
    "project_points": f"""SELECT row_no, coalesce(CAST(x AS VARCHAR), 'N/A') AS x_coordinate, CAST(y AS VARCHAR) AS y_coordinate,
        {r6('lat')} AS latitude, {r6('lon')} AS longitude, {r6('round(x, 5) + 0e0')} AS x_back, {r6('CASE WHEN x IS NOT NULL THEN y + 0e0 END')} AS y_back
        FROM (SELECT *, {site_lon} AS lon, {site_lat} AS lat FROM site_rows)""",
    "incident_weights": f"SELECT cmplnt_num, unit AS geo_unit, {weights_tail} FROM clean",
    "incident_weights_max": f"SELECT cmplnt_num, boro AS geo_unit, {r6('greatest(law, floor_max)')} AS severity_weight, {r6('factor')} AS attempt_factor, {r6('greatest(law, floor_max) * factor')} AS weighted_incident FROM incidents",
    "incident_units": units_select("units"),
    "incident_boroughs": units_select("boroughs"),
    "incident_points": f"""SELECT cmplnt_num, unit AS geo_unit, {boro_raw} AS boro_nm, {pct_raw} AS addr_pct_cd, {offense_raw} AS ofns_desc,
        {law_raw} AS law_cat_cd, {attempt_raw} AS crm_atpt_cptd_cd, {weights_tail}, {r6('x')} AS x_coord_cd, {r6('y')} AS y_coord_cd,
        {r6('lat')} AS latitude, {r6('lon')} AS longitude, valid AS has_valid_point FROM clean""",
    "stream_zone_totals": f"""SELECT zone_id, count(cmplnt_num) AS incident_count, {r6('sum(weighted)')} AS weighted_severity_sum
        FROM zone_incidents GROUP BY zone_id""",
    "stream_incident_medians": f"""SELECT geo_unit, incident_count, {r6('weighted_severity_sum')} AS weighted_severity_sum, valid_point_count,
        {r6('representative_x')} AS representative_x, {r6('representative_y')} AS representative_y,
        {r6('representative_latitude')} AS representative_latitude, {r6('representative_longitude')} AS representative_longitude,
        point_coverage_rate FROM bucketed_units""",
    "stream_incident_units": f"SELECT geo_unit, incident_count, {r6('weighted_severity_sum')} AS weighted_severity_sum, valid_point_count FROM units",
    "t_csv_bad_rows": """SELECT CASE WHEN c_custkey % 5 <> 1 THEN c_mktsegment END AS segment, count(*) AS n,
        count(c_name) AS named, CAST(sum(c_custkey) AS BIGINT) AS id_sum
        FROM customer WHERE c_custkey % 5 NOT IN (2, 3) GROUP BY 1""",
    "t_csv_roundtrip": f"SELECT {boro_raw} AS boro_nm, count(*) AS n, count(cmplnt_num) AS numbered, count({offense_raw}) AS described, {r6('sum(raw_lat)')} AS latitude_sum FROM incidents GROUP BY 1",
    "geo_boundaries": f"""SELECT zone_id, 'AREA_' || zone_id AS zone_name, count(DISTINCT part) AS part_count, count(*) AS edge_count,
        {r6('min(x1)')} AS xmin, {r6('min(y1)')} AS ymin, {r6('max(x1)')} AS xmax, {r6('max(y1)')} AS ymax,
        {r6('sum(s * (x1 * y2 - x2 * y1)) / 2 * 1e6')} AS area FROM sa GROUP BY zone_id""",
    "zone_centroid": f"SELECT zone_id, {r6('lat')} AS representative_latitude, {r6('lon')} AS representative_longitude FROM centroids",
    "point_zone_first": "SELECT event_id, CAST(min(k) AS VARCHAR) AS zone_id FROM event_hits GROUP BY event_id",
    "point_zone_adaptive": "SELECT event_id, CAST(min(k) AS VARCHAR) AS zone_id FROM event_hits GROUP BY event_id",
    "point_block_groups": f"SELECT DISTINCT event_id, {BOROUGH.replace('zone_id', 'CAST(k AS VARCHAR)')} AS zone_id FROM block_hits",
    "borough_outlines": f"""SELECT borough AS zone_id, {r6('area * 1000')} AS area, {r6('border')} AS border
        FROM (SELECT borough, sum({width} * {height} / 4) AS area FROM borough_triangle GROUP BY borough)
        JOIN (SELECT borough, sum(length) AS border FROM borough_side GROUP BY borough) USING (borough)""",
    "incident_zone_join": f"SELECT cmplnt_num, zone_id, zone_name, {r6('weighted')} AS weighted_incident FROM zone_incidents",
    "incident_zone_index": f"""SELECT zone_id AS community_district_id, zone_name AS community_district_name, n AS incident_count,
        {r6('severity_sum')} AS weighted_severity_sum, n AS valid_point_count, 1e0 AS point_coverage_rate,
        {r6('lat')} AS representative_latitude, {r6('lon')} AS representative_longitude, {r6('burden_z')} AS crimeburden_z,
        {r6('safety')} AS safetyscore, rank, {segment()} AS segment FROM zone_safety""",
    "zone_quality": zone_quality_select("water_zones", "water", "waterscore"),
    "education_zone_quality": zone_quality_select("school_zones", "education", "educationscore"),
    "zone_overlay": f"""SELECT source_id, target_id, {r6('source_area / 1e6')} AS source_area, {r6('target_area / 1e6')} AS target_area,
        {r6('inter / 1e6')} AS intersection_area, {r6('weight')} AS weight, {r6('share')} AS source_share FROM pieces""",
    "combined_index": f"""SELECT {listed(INDEX_NAMES)} FROM (
        SELECT *, {rank('overall_qualityscore', 'community_district_id', True)} AS overall_rank FROM (
          SELECT *, {row_mean(METRIC_NAMES)} AS overall_qualityscore FROM (
            SELECT a.*, s.* EXCLUDE (id), w.score AS waterscore, w.quality AS water_qualityscore, w.n AS water_point_count,
                   e.score AS educationscore, e.quality AS education_qualityscore, e.n AS education_point_count
            FROM (SELECT geo_join_id AS community_district_id, geo_place_name AS community_district_name, no2, o3, pm2_5,
                         airscore, {quality('airscore', False)} AS air_qualityscore FROM air) a
            LEFT JOIN (SELECT zone_id AS id, safety AS safetyscore, n AS incident_count, severity_sum AS weighted_severity_sum,
                              {quality('safety', True)} AS safety_qualityscore FROM zone_safety) s ON s.id = community_district_id
            LEFT JOIN water_zones w ON w.zone_id = community_district_id
            LEFT JOIN school_zones e ON e.zone_id = community_district_id)))""",
    # Corners as text the way the file has them: the first corner again at the end, but for the diamond.
    "geo_features": f"""SELECT zone_id AS geo_id, {DISTRICT_LABEL.format('zone_id')} AS geo_label,
        '{{"type":"Feature","properties":{{"geo_id":"' || zone_id || '","geo_label":"' || {DISTRICT_LABEL.format('zone_id')}
        || '"}},"geometry":{{"type":"MultiPolygon","coordinates":[' || string_agg(part_text, ',' ORDER BY part) || ']}}}}' AS feature
        FROM (SELECT zone_id, part, '[' || string_agg(ring_text, ',' ORDER BY ring) || ']' AS part_text FROM (
          SELECT zone_id, part, ring, '[' || string_agg(corner_text, ',' ORDER BY seq) || CASE k % 10 WHEN 4 THEN '' ELSE ',' || first(corner_text ORDER BY seq) END || ']' AS ring_text
          FROM (SELECT *, '[' || x || ',' || y || ']' AS corner_text FROM va) GROUP BY k, zone_id, part, ring) GROUP BY zone_id, part)
        WHERE zone_id IN (SELECT community_district_id FROM idx) GROUP BY zone_id""",
    # One outline of all members, in file order; every borough with a district has a record.
    "geo_features_borough": f"""SELECT borough AS geo_id, borough AS geo_label,
        '{{"type":"Feature","properties":{{"geo_id":"' || borough || '","geo_label":"' || borough
        || '"}},"geometry":{{"type":"MultiPolygon","coordinates":[' || string_agg(part_text, ',' ORDER BY k, part) || ']}}}}' AS feature
        FROM (SELECT {BOROUGH} AS borough, k, part, '[' || string_agg(ring_text, ',' ORDER BY ring) || ']' AS part_text FROM (
          SELECT k, zone_id, part, ring, '[' || string_agg(corner_text, ',' ORDER BY seq) || CASE k % 10 WHEN 4 THEN '' ELSE ',' || first(corner_text ORDER BY seq) END || ']' AS ring_text
          FROM (SELECT *, '[' || x || ',' || y || ']' AS corner_text FROM va) GROUP BY k, zone_id, part, ring) GROUP BY k, zone_id, part)
        GROUP BY borough""",
    "t_collection_roundtrip": """SELECT zone_id, 'AREA_' || zone_id AS zone_name, count(DISTINCT part) AS part_count
        FROM va GROUP BY zone_id""",
    "t_reference_systems": f"""SELECT zone_id, {r6('min(x) * 1e4')} AS xmin, {r6('min(y) * 1e4')} AS ymin, {r6('max(x) * 1e4')} AS xmax,
        {r6('max(y) * 1e4')} AS ymax FROM va GROUP BY zone_id""",
    "t_boundary_roundtrip": """SELECT zone_id, 'AREA_' || zone_id AS zone_name, count(DISTINCT part) AS part_count
        FROM va GROUP BY zone_id""",
    "t_index_roundtrip": f"""SELECT community_district_id, community_district_name, borough, {r6('airscore')} AS airscore,
        {r6('waterscore')} AS waterscore, {r6('overall_qualityscore')} AS overall_qualityscore FROM idx""",
    "index_table": f"SELECT {listed(INDEX_NAMES)} FROM idx",
    "index_records": f"""SELECT community_district_id AS geo_id,
        {DISTRICT_LABEL.format('community_district_id')} AS label,
        community_district_name AS name, borough, 'community_district' AS geography_type,
        {half_even('overall_qualityscore')} AS overall, {half_even('air_qualityscore')} AS air, {half_even('water_qualityscore')} AS water,
        {half_even('education_qualityscore')} AS edu, {half_even('safety_qualityscore')} AS nypd, overall_rank AS rank,
        {half_even('pm2_5', 3)} AS pm25, water_point_count AS sample_sites, education_point_count AS schools,
        incident_count AS incidents, {half_even('weighted_severity_sum', 1)} AS weighted_severity_sum FROM idx""",
    "area_profile": f"SELECT community_district_id AS geo_id, community_district_name AS name, borough, {half_even('overall_qualityscore')} AS overall FROM idx WHERE community_district_id = '5'",
    "index_json": f"""SELECT community_district_id AS geo_id, CAST(to_json({{'name': community_district_name,
        'overall': {half_even('overall_qualityscore')}, 'air': {half_even('air_qualityscore')}, 'water': {half_even('water_qualityscore')},
        'edu': {half_even('education_qualityscore')}, 'nypd': {half_even('safety_qualityscore')}}}) AS VARCHAR) AS record FROM idx""",
    "rollup_zone": rolled_select("pieces", "weight", "'BLOCK_' || geo_id"),
    "rollup_zone_source_share": rolled_select("pieces", "share", "'BLOCK_' || geo_id"),
    "rollup_borough": rolled_select("borough_pieces", "weight", "geo_id"),
    "borough_record_rows": f"""SELECT geo_id, geo_id AS name, geo_id AS borough, {half_even('overall_qualityscore')} AS overall, overall_rank AS rank,
        'Borough rollup of community-district prototype scores.' AS method FROM ({rolled('borough_pieces', 'weight')})""",
    "city_summary": f"""SELECT count(*) AS area_count, {r6(f'avg({overall_q})')} AS average_overall, {r6(f'max({overall_q})')} AS highest_overall,
        {r6(f'min({overall_q})')} AS lowest_overall, {r6(f'max({overall_q}) - min({overall_q})')} AS score_range, {r6(f'median({overall_q})')} AS median_overall FROM idx""",
    "metric_stats": f"""SELECT metric, {r6('average')} AS average, {r6('deviation')} AS deviation,
        t.community_district_id AS top_id, t.community_district_name AS top_name, {r6('t.score')} AS top_score,
        b.community_district_id AS bottom_id, b.community_district_name AS bottom_name, {r6('b.score')} AS bottom_score,
        row_number() OVER (ORDER BY round(average, 9) DESC NULLS LAST, m.metric_no) = 1 AS strongest,
        row_number() OVER (ORDER BY round(average, 9) NULLS LAST, m.metric_no) = 1 AS weakest,
        row_number() OVER (ORDER BY round(deviation, 9) DESC NULLS LAST, m.metric_no) = 1 AS most_variable
        FROM (SELECT metric_no, metric, avg(score) AS average, stddev_samp(score) AS deviation FROM metric_rows GROUP BY ALL) m
        JOIN (SELECT * FROM metric_rows WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(score, 9) DESC, community_district_id) = 1) t USING (metric)
        JOIN (SELECT * FROM metric_rows WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(score, 9), community_district_id) = 1) b USING (metric)""",
    "borough_avg": f"SELECT borough, {r6(f'avg({overall_q})')} AS average_overall FROM idx GROUP BY borough",
    "top_bottom": f"{extreme(overall_q, 10, True, top_columns, 'top')} UNION ALL {extreme(overall_q, 10, False, top_columns, 'bottom')}",
    "leaderboards": " UNION ALL ".join(
        f"SELECT metric, '{side}' AS side, place, community_district_name, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(score, 9) {order} NULLS LAST, community_district_id) AS place FROM metric_rows) WHERE place <= 5"
        for side, order in (("top", "DESC"), ("bottom", "ASC"))
    ),
    "balance_top": f"{extreme('metric_range', 5, False, balance_columns, 'balanced')} UNION ALL {extreme('metric_range', 5, True, balance_columns, 'uneven')}",
    "rank_curve": f"SELECT {listed(['community_district_id', 'community_district_name', 'borough', overall_q, *METRIC_NAMES, 'overall_rank', 'metric_range'])} FROM idx",
    "score_histogram": f"""SELECT CAST(bin * 10 AS VARCHAR) || '-' || CAST(bin * 10 + 10 AS VARCHAR) AS label,
        (SELECT count(*) FROM idx WHERE {overall_q} IS NOT NULL AND least(floor({overall_q} / 10), 9) = bin) AS area_count FROM range(10) AS t(bin)""",
    "score_bands": "SELECT community_district_id, "
    + ", ".join(f"{BAND.format(c)} AS {c.replace('_qualityscore', '_band')}" for c in [overall_q, *METRIC_NAMES])
    + " FROM idx",
    "compare_areas": " UNION ALL ".join(
        f"SELECT {quoted(label)} AS metric, {r6('a')} AS a, {r6('b')} AS b, {r6('a - b')} AS diff FROM (SELECT max({c}) FILTER (community_district_id = '5') AS a, max({c}) FILTER (community_district_id = '8') AS b FROM idx)"
        for label, c in compare_list
    ),
    "compare_wide": "SELECT "
    + ", ".join(
        f"max({c if c in TEXT else r6(c)}) FILTER (community_district_id = '{area}') AS {c}_{side}"
        for side, area in (("a", "5"), ("b", "8"))
        for c in ["community_district_id", "community_district_name", overall_q, *METRIC_NAMES]
    )
    + " FROM idx",
}

# Stored and read back, these have to be the same.
SELECTS["stored_index"], SELECTS["stored_profile"] = SELECTS["index_table"], SELECTS["area_profile"]

SELECTS["laid_out_district"] = SELECTS["incident_zone_join"] + " WHERE zone_id = '5'"

SELECTS["edge_points_strict"] = SELECTS["edge_points_strict_adaptive"] = (
    f"SELECT {r6('lon')} AS longitude, {r6('lat')} AS latitude, CAST(k AS VARCHAR) AS zone_id FROM edge_hits"
)
SELECTS["incident_refresh"] = SELECTS["stream_incident_medians"]


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*\.)", sql):
            _needed(CTES[name], found)
            found[name] = None


def sql_of(name: str) -> str:
    """The full statement, with only the named subqueries it needs."""
    found: dict[str, None] = {}
    _needed(SELECTS[name], found)
    withs = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in found)
    return f"WITH {withs}\n{SELECTS[name]}" if withs else SELECTS[name]


def oracle_sql() -> dict[str, str]:
    return {name: sql_of(name) for name in SELECTS}
