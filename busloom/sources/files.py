"""Feed CSV, GeoJSON, map extracts, probe logs and rain as DataFrames; GeoJSON and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the feed files.
FEED = {
    "routes": "route_id string, route_type int",
    "trips": "route_id string, trip_id string, direction_id int, shape_id string",
    "stops": "stop_id string, stop_name string, stop_desc string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time string",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled double",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs double",
}


def read_feed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One file of an unpacked feed; columns are matched by the header, other columns dropped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{table}.txt")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    want = [p.strip().split(" ") for p in FEED[table].split(",")]
    return raw.select(
        *[(F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in want]
    )


_FEATURES = (
    "features array<struct<geometry:struct<type:string, coordinates:string>, properties:map<string,string>>>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature with a geometry: type, coordinates (as JSON text), properties."""
    raw = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("ordem", "f"))
    return f.where("f.geometry IS NOT NULL AND f.geometry.coordinates IS NOT NULL").select(
        "ordem", F.col("f.geometry.type").alias("tipo"), F.col("f.geometry.coordinates").alias("coordenadas"),
        F.col("f.properties").alias("propriedades"),
    )


def _parse(depth: int) -> Column:
    kind = "array<" * depth + "double" + ">" * depth
    return F.from_json("coordenadas", kind)


def geojson_points(features: DataFrame) -> DataFrame:
    p = features.where("tipo = 'Point'").withColumn("c", _parse(1))
    return p.select("ordem", "propriedades", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


def geojson_lines(features: DataFrame) -> DataFrame:
    """Points of LineString and MultiLineString features: one row per vertex with its part."""
    one = features.where("tipo = 'LineString'").withColumn("partes", F.array(_parse(2)))
    many = features.where("tipo = 'MultiLineString'").withColumn("partes", _parse(3))
    d = one.unionByName(many)
    d = d.select("ordem", "propriedades", F.posexplode("partes").alias("parte", "linha"))
    d = d.select("ordem", "propriedades", "parte", F.posexplode("linha").alias("seq", "c"))
    return d.select("ordem", "propriedades", "parte", "seq", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


def geojson_edges(features: DataFrame, name: str) -> DataFrame:
    """Edges of all rings of Polygon and MultiPolygon features, holes included."""
    one = features.where("tipo = 'Polygon'").withColumn("aneis", _parse(3))
    many = features.where("tipo = 'MultiPolygon'").withColumn("aneis", F.flatten(_parse(4)))
    d = one.unionByName(many).select("ordem", F.col("propriedades").getItem(name).alias("zona"), F.explode("aneis").alias("anel"))
    nxt = F.concat(F.slice("anel", 2, F.size("anel") - 1), F.slice("anel", 1, 1))
    d = d.select("ordem", "zona", F.explode(F.arrays_zip(F.col("anel").alias("a"), nxt.alias("b"))).alias("e"))
    return d.select(
        "zona", "ordem", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
    ).where("x1 <> x2 OR y1 <> y2")


_OSM = (
    "elements array<struct<type:string, id:bigint, lat:double, lon:double, tags:map<string,string>, "
    "geometry:array<struct<lat:double, lon:double>>>>"
)


def read_map_extract(spark: SparkSession, path: str) -> DataFrame:
    """Node and way elements of a map extract with tags and geometry."""
    raw = spark.read.schema(_OSM).option("multiLine", True).json(path)
    return raw.select(F.explode("elements").alias("e")).select("e.*")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines probe log, answered calls only."""
    s = "ts timestamp, ponto string, status int, lat double, lon double, velocidade_kmh double, velocidade_livre_kmh double"
    return spark.read.schema(s).json(path).where("status = 200")


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("lat", "lon", "hora_local", "chuva_mm")


def cluster_features(clusters: DataFrame, ring: str, lat: str, lon: str, props: list[str]) -> DataFrame:
    """One GeoJSON feature text per cluster: its hull, or its centre when it has no hull."""
    poly = F.struct(F.lit("Polygon").alias("type"), F.array(F.col(ring)).alias("coordinates"))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    geom = F.when(F.col(ring).isNotNull(), F.to_json(poly)).otherwise(F.to_json(point))
    text = F.concat(
        F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), F.to_json(F.struct(*props)), F.lit("}")
    )
    return clusters.select(text.alias("value"))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features: each task writes its own part."""
    features.write.mode("overwrite").text(path)


def read_cluster_features(spark: SparkSession, path: str) -> DataFrame:
    """Cluster features back as rows: properties as a map, ring as an array (NULL for points)."""
    s = "geometry struct<type:string, coordinates:string>, properties map<string,string>"
    d = spark.read.schema(s).json(path)
    ring = F.when(F.col("geometry.type") == "Polygon", F.from_json("geometry.coordinates", "array<array<array<double>>>")[0])
    return d.select(F.col("properties").alias("propriedades"), ring.alias("anel"))


def itinerary_feature(stops: DataFrame, shape: DataFrame, key: str) -> DataFrame:
    """Line and ordered stops of an itinerary as one feature collection text per key.

    `shape`: key, seq, lat, lon. `stops`: key, ordem, cp, s_m, dist_tracado_m, lat, lon.
    """
    from busloom.operators.ordered import lagged

    line = shape.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    line = line.select(key, F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(q["lon"], q["lat"])).alias("coordinates")).alias("geometry"),
    )).alias("_l"))
    st = lagged(stops, [key], ["ordem", "cp"], {"_s": "s_m"}).withColumn("espaco_m", F.col("s_m") - F.col("_s"))
    feat = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("cp", "ordem", "s_m", "espaco_m", "dist_tracado_m").alias("properties"),
    ))
    pts = st.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordem", "cp", feat.alias("f")))).alias("_p"))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("_l"), F.lit(","),
                    F.array_join(F.transform("_p", lambda q: q["f"]), ","), F.lit("]}"))
    return line.join(pts, key).select(key, body.alias("geojson"))


def spacing_summary(stops: DataFrame, key: str) -> DataFrame:
    """Stops, total length, and spacing between stops of each itinerary."""
    from busloom.operators.ordered import lagged
    from busloom.operators.quantiles import summarize

    st = lagged(stops, [key], ["ordem", "cp"], {"_s": "s_m"}).withColumn("espaco_m", F.col("s_m") - F.col("_s"))
    aggs = [
        F.count("*").alias("paradas"), F.max("s_m").alias("extensao_m"), F.min("espaco_m").alias("espaco_min_m"),
        F.max("espaco_m").alias("espaco_max_m"), F.avg("espaco_m").alias("espaco_medio_m")]
    return summarize(st, [key], aggs, {"espaco_m": {"espaco_mediano_m": 0.5}})
