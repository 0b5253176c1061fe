"""JSON and GeoJSON documents: catalogues, atlases, zones, ways, manifests and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<minimum_latitude: double, maximum_latitude: double, minimum_longitude: double, maximum_longitude: double>"
CATALOG = f"""id string, provider string, feed_name string, status string, official boolean,
source_info struct<producer_url: string, authentication_type: int>,
latest_dataset struct<id: string, hosted_url: string, service_date_range_start: string, service_date_range_end: string, bounding_box: {BBOX}>"""
ATLAS = """feeds array<struct<id: string, spec: string, urls: struct<static_current: string, static_historic: array<string>>, operators: array<struct<name: string>>>>,
operators array<struct<name: string, associated_feeds: array<struct<feed_onestop_id: string>>>>"""
FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
RING = "array<array<array<double>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """feed_id, provider, feed_name, status, dataset_id, url, service_start, service_end, bbox, producer_url, producer_auth of saved catalogue records."""
    raw = spark.read.schema(CATALOG).json(path, multiLine=True)
    box, data = F.col("latest_dataset.bounding_box"), F.col("latest_dataset")
    bbox = F.struct(box["minimum_latitude"].alias("south"), box["minimum_longitude"].alias("west"), box["maximum_latitude"].alias("north"), box["maximum_longitude"].alias("east"))
    return raw.select(F.col("id").alias("feed_id"), "provider", "feed_name", "status", data["id"].alias("dataset_id"), data["hosted_url"].alias("url"), data["service_date_range_start"].alias("service_start"), data["service_date_range_end"].alias("service_end"), bbox.alias("bbox"), F.col("source_info.producer_url").alias("producer_url"), F.col("source_info.authentication_type").alias("producer_auth"))


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """Feeds and operators of a directory of atlas files; those that can't be parsed are skipped."""
    return spark.read.schema(ATLAS).json(path, multiLine=True, mode="DROPMALFORMED")


#: Names of weekdays in documents of zones, from Monday.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def read_zones(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """zone_id, name, agency, rings ((lon, lat) arrays of all polygons), service (weekday, 0 for Monday: windows of start, end and headway, if any), source,
    info_url of a GeoJSON FeatureCollection, or with ``lines`` of features a line each, as ``write_zones`` leaves them."""
    if lines:
        rows = spark.read.schema(FEATURE).json(path).select(F.struct("*").alias("f"))
    else:
        rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json(coordinates, RING)).otherwise(F.flatten(F.from_json(coordinates, f"array<{RING}>")))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    get = lambda n: F.col("f.properties")[n]
    number = lambda w, i: F.get(w, F.lit(i)).cast("int")
    given = F.from_json(get("service"), "map<string, array<array<double>>>")
    windows = lambda w: F.struct(number(w, 0).alias("start"), number(w, 1).alias("end"), number(w, 2).alias("headway"))
    days = F.create_map(*[x for i, d in enumerate(WEEKDAYS) for x in (F.lit(d), F.lit(i))])
    service = F.map_from_entries(F.transform(F.map_entries(F.coalesce(given, F.create_map().cast("map<string, array<array<double>>>"))), lambda e: F.struct(F.element_at(days, e["key"]).alias("key"), F.transform(e["value"], windows).alias("value"))))
    return rows.select(get("zone_id").alias("zone_id"), get("name").alias("name"), get("agency").alias("agency"), points.alias("rings"), service.alias("service"), get("source").alias("source"), get("info_url").alias("info_url"))


def write_zones(zones: DataFrame, path: str) -> None:
    """A GeoJSON MultiPolygon feature a line and zone, with its service by the names of weekdays."""
    rings = F.transform("rings", lambda r: F.array(F.transform(r, lambda p: F.array(p["lon"], p["lat"]))))
    own = [F.col(c) for c in ("zone_id", "name", "agency", "source", "info_url") if c in zones.columns]
    if "service" in zones.columns:
        names = F.array(*[F.lit(d) for d in WEEKDAYS])
        own.append(F.map_from_entries(F.transform(F.map_entries("service"), lambda e: F.struct(F.element_at(names, e["key"] + 1).alias("key"), F.transform(e["value"], lambda w: F.array(w["start"], w["end"], w["headway"])).alias("value")))).alias("service"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*own).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    zones.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, tags, nodes of road ways in Parquet."""
    return spark.read.parquet(path).select("way_id", "tags", "nodes")


def write_road_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def write_manifest(kept: DataFrame, rejected: DataFrame, path: str) -> None:
    """Kept feeds, and rejected ones with the reason."""
    kept.write.mode("overwrite").json(f"{path}/feeds")
    rejected.write.mode("overwrite").json(f"{path}/rejected")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/feeds")


def route_documents(runs: DataFrame, routes: DataFrame, legs: DataFrame, profile: DataFrame, feeds: DataFrame) -> DataFrame:
    """query_id, value: one JSON document for each of ``runs`` (query_id and what it has of its own, as its window, walking limit and note), with its routes in order of rank: totals,
    miles by class, legs in order, connections, their summary and feeds.

    ``routes``: query_id, rank, and a route's own columns; ``legs``: query_id, rank, leg_no, ...; ``profile``: query_id, rank, dep, arr; ``feeds``: query_id, rank, feed_id. A
    document holds the routes offered for one question, some twenty at most, so no list grows with the number of runs."""
    key = ["query_id", "rank"]
    own = lambda df, skip: F.struct(*[c for c in df.columns if c not in skip])
    listed = legs.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("leg_no", own(legs, [*key, "leg_no"]).alias("leg")))), lambda x: x["leg"]).alias("legs"))
    took = F.col("arr") - F.col("dep")
    trips = profile.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dep", "arr"))), lambda x: F.array(x["dep"], x["arr"])).alias("connections"),
        F.struct(F.count("*").alias("connections"), F.min(took).cast("bigint").alias("min_duration_s"), F.floor(F.median(took)).cast("bigint").alias("median_duration_s"), F.max(took).cast("bigint").alias("max_duration_s")).alias("profile"),
    )
    used = feeds.groupBy(*key).agg(F.array_sort(F.collect_set("feed_id")).alias("feeds"))
    whole = routes.join(listed, key, "left").join(trips, key, "left").join(used, key, "left")
    whole = whole.withColumns({c: F.coalesce(c, F.array().cast(whole.schema[c].dataType)) for c in ("legs", "connections", "feeds")})
    whole = whole.withColumn("profile", F.coalesce("profile", F.struct(F.lit(0).cast("bigint").alias("connections"), *[F.lit(None).cast("bigint").alias(f"{n}_duration_s") for n in ("min", "median", "max")])))
    sets = whole.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", own(whole, key).alias("route")))), lambda x: x["route"]).alias("routes"))
    out = runs.join(sets, "query_id", "left")
    return out.select("query_id", F.to_json(own(out, ["query_id"])).alias("value"))


def route_features(legs: DataFrame) -> DataFrame:
    """query_id, value: a GeoJSON FeatureCollection for each query_id with a LineString per leg, in order of rank and leg_no.

    ``legs``: query_id, rank, label, leg_no, kind, from and to (structs with name, lon, lat), services (array of structs with agency and route), headway; the last two
    are told of rides only."""
    line = F.array(*[F.array(F.col(f"{x}.lon"), F.col(f"{x}.lat")) for x in ("from", "to")])
    ridden = F.col("kind") != "walk"
    services = F.when(ridden, F.array_join(F.transform(F.coalesce("services", F.array().cast(legs.schema["services"].dataType)), lambda x: F.concat_ws(" ", x["agency"], x["route"])), ", "))
    told = F.struct(F.col("rank").alias("route_rank"), F.col("label").alias("route_label"), "kind", F.col("from.name").alias("from"), F.col("to.name").alias("to"), services.alias("services"), F.when(ridden, F.col("headway")).alias("effective_headway_s"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), told.alias("properties"))
    listed = legs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "leg_no", feature.alias("feature")))), lambda x: x["feature"]).alias("features"))
    return listed.select("query_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A document a line below a folder for each query_id: what ``route_documents`` and ``route_features`` give."""
    documents.write.mode("overwrite").partitionBy("query_id").text(path)
