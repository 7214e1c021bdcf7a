"""Export queries (S14, S15): GeoJSON texts of clusters and itineraries."""

from pyspark.sql import functions as F

from busloom.operators.spatial import convex_hulls
from busloom.plans.q_delay import rounded
from busloom.plans.registry import query
from busloom.plans.standins import Bus, oracle
from busloom.sources import files as FL


@query("s14_cluster_geojson", oracle("points hulls", """
SELECT concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[', anel, ']},"properties":{"label":', label, ',"n":', n, '}}') AS value
FROM hulls JOIN (SELECT label, count(*) AS n FROM points GROUP BY 1) USING (label)"""))
def s14(spark, sf):
    p = Bus(spark, sf).points
    c = p.groupBy("label").agg(F.avg("x").alias("lon"), F.avg("y").alias("lat"), F.count("*").alias("n"))
    return FL.cluster_features(c.join(convex_hulls(p, "label"), "label"), "anel", "lat", "lon", ["label", "n"])


def placed(b):
    return b.line_stops.withColumn("dist_tracado_m", F.lit(0.0)).join(b.stops, "cp")


@query("s15_itinerary_export", oracle("line_stops stops", """
, p AS (SELECT l.*, s.lat, s.lon, s_m - lag(s_m) OVER (PARTITION BY cl ORDER BY ordem, l.cp) AS e FROM line_stops l JOIN stops s ON s.cp = l.cp)
SELECT cl, concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[',
  string_agg(concat('[', lon, ',', lat, ']'), ',' ORDER BY ordem, lat, lon), ']}},',
  string_agg(concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', lon, ',', lat, ']},"properties":{"cp":', cp, ',"ordem":', ordem, ',"s_m":', s_m,
    CASE WHEN e IS NULL THEN '' ELSE concat(',"espaco_m":', e) END, ',"dist_tracado_m":0.0}}'), ',' ORDER BY ordem, cp), ']}') AS geojson FROM p GROUP BY cl""".strip()))
def s15(spark, sf):
    s = placed(Bus(spark, sf))
    return FL.itinerary_feature(s, s.select("cl", F.col("ordem").alias("seq"), "lat", "lon"), "cl")


@query("s15_stop_spacing", oracle("line_stops", """
SELECT cl, count(*) AS paradas, max(s_m) AS extensao_m, min(e) AS espaco_min_m, max(e) AS espaco_max_m, round(avg(e), 6) AS espaco_medio_m, median(e) AS espaco_mediano_m
FROM (SELECT *, s_m - lag(s_m) OVER (PARTITION BY cl ORDER BY ordem, cp) AS e FROM line_stops) GROUP BY cl"""))
def s15b(spark, sf):
    return rounded(FL.spacing_summary(placed(Bus(spark, sf)), "cl"), "espaco_medio_m")
