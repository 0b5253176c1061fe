"""Which feeds are used: selection from a catalogue, duplicates, fresher copies from an atlas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.config import CORRIDOR, EXCLUDED_FEED_NAMES, EXCLUDED_PROVIDERS, USABLE_STATUSES
from transit_spark.functions.geo import bbox_near_polyline, distance_to_polyline_m
from transit_spark.functions.text import norm_name, norm_url


def select_feeds(catalog: DataFrame, today: str, spine: Sequence[tuple[float, float]] = CORRIDOR, buffer_km: float = 60.0, providers: Sequence[str] = EXCLUDED_PROVIDERS, names: Sequence[str] = EXCLUDED_FEED_NAMES) -> DataFrame:
    """``catalog`` (feed_id, provider, feed_name, status, url, service_end, bbox struct<south,west,north,east>, ...) with stale and
    reason, the first test that a feed fails; null where it is kept. ``providers`` and ``names`` are patterns of providers and of
    feed names that are left out. A feed without a complete box is not tested by place; one without a status is not usable."""
    box = F.col("bbox")
    whole = F.coalesce(box["south"].isNotNull() & box["west"].isNotNull() & box["north"].isNotNull() & box["east"].isNotNull(), F.lit(False))
    near = bbox_near_polyline(box["south"], box["west"], box["north"], box["east"], spine, buffer_km * 1000)
    status = F.coalesce("status", F.lit(""))
    out = F.when(~status.isin(*USABLE_STATUSES), F.concat(F.lit("status "), status))
    for column, patterns, said in (("provider", providers, "provider excluded (not fixed-fare local bus)"), ("feed_name", names, "feed name excluded (rail/ferry/flex)")):
        if patterns:
            out = out.when(F.coalesce(column, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), said)
    out = out.when(F.coalesce("url", F.lit("")) == "", "no hosted dataset").when(whole & ~near, "outside the corridor")
    stale = F.to_date(F.substring("service_end", 1, 10)) < F.to_date(F.lit(today))
    return catalog.withColumns({"stale": F.coalesce(stale, F.lit(False)), "reason": out})


def dedup_catalog(feeds: DataFrame) -> DataFrame:
    """``feeds`` with reason: of feeds with the same normalised provider and feed name, inactive ones go where another is live."""
    same = W.partitionBy(norm_name(F.concat_ws(" ", F.coalesce("provider", F.lit("")), F.coalesce("feed_name", F.lit("")))))
    live = F.min(F.when(F.col("status") != "inactive", F.col("feed_id"))).over(same)
    return feeds.withColumn("_live", live).withColumn("reason", F.when((F.col("status") == "inactive") & F.col("_live").isNotNull(), F.concat(F.lit("inactive duplicate of "), F.col("_live").cast("string")))).drop("_live")


def load_filter(manifest: DataFrame, date: str, exclude_feed: list[str] | None = None, max_stale_days: int | None = None, providers: Sequence[str] = EXCLUDED_PROVIDERS) -> DataFrame:
    """Feeds with a path, not excluded by id or by provider (except those from the atlas), and not over ``max_stale_days`` past their end."""
    out = manifest.where(F.coalesce("path", F.lit("")) != "")
    if exclude_feed:
        out = out.where(~F.col("feed_id").isin(*exclude_feed))
    if providers:
        out = out.where((F.coalesce("source", F.lit("")) == "atlas-extra") | ~F.coalesce("provider", F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in providers)))
    if max_stale_days is not None:
        late = F.datediff(F.to_date(F.lit(date)), F.to_date(F.substring("service_end", 1, 10)))
        out = out.where(F.coalesce(late, F.lit(0)) <= max_stale_days)
    return out


def near_corridor(stops: DataFrame, zone_points: DataFrame, spine: list[tuple[float, float]], buffer_km: float = 60.0) -> DataFrame:
    """feed_id of feeds with a stop or a zone vertex (feed_id, lat, lon) within the buffer."""
    points = stops.select("feed_id", "lat", "lon").unionByName(zone_points.select("feed_id", "lat", "lon"))
    return points.groupBy("feed_id").agg(F.min(distance_to_polyline_m(F.col("lat"), F.col("lon"), spine)).alias("d")).where(F.col("d") <= buffer_km * 1000).select("feed_id")


def exclude_agencies(feeds: DataFrame, patterns: DataFrame, regexes: list[str]) -> DataFrame:
    """``patterns`` (feed_id, agency, route_name, ...) of feeds whose provider and id match no regex, less those whose agency or agency and route do."""
    if not regexes:
        return patterns.join(feeds, "feed_id", "left_semi")
    any_ = "(?i)" + "|".join(f"(?:{r})" for r in regexes)
    kept = feeds.where(~F.coalesce("provider", F.lit("")).rlike(any_) & ~F.col("feed_id").cast("string").rlike(any_))
    named = F.concat_ws(" ", F.coalesce("agency", F.lit("")), F.coalesce("route_name", F.lit("")))
    return patterns.join(kept, "feed_id", "left_semi").where(~F.coalesce("agency", F.lit("")).rlike(any_) & ~named.rlike(any_))


def flatten_atlas(records: DataFrame) -> DataFrame:
    """onestop_id, url, historic, operators of atlas files (feeds, operators): names of the operators written below a feed and of those of its
    file that name it, each once; where there is none that of the only operator of the file."""
    rows = records.withColumn("_file", F.monotonically_increasing_id())
    feeds = rows.select("_file", F.explode("feeds").alias("f")).where("f.spec = 'gtfs'")
    feeds = feeds.select("_file", F.col("f.id").alias("onestop_id"), F.col("f.urls.static_current").alias("url"), F.coalesce("f.urls.static_historic", F.array().cast("array<string>")).alias("historic"), F.col("f.operators.name").alias("own"))
    listed = rows.select("_file", F.explode("operators").alias("o")).select("_file", F.col("o.name").alias("name"), "o.associated_feeds")
    named = listed.select("_file", F.coalesce("name", F.lit("")).alias("name"), F.explode("associated_feeds").alias("a")).groupBy("_file", F.col("a.feed_onestop_id").alias("onestop_id")).agg(F.array_sort(F.collect_set("name")).alias("named"))
    only = listed.groupBy("_file").agg(F.count("*").alias("n"), F.first("name").alias("name")).where("n = 1 and name <> ''").select("_file", F.array("name").alias("only"))
    out = feeds.join(named, ["_file", "onestop_id"], "left").join(only, "_file", "left")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.filter(F.coalesce("own", none), lambda n: n != ""), F.coalesce("named", none)))
    return out.select("onestop_id", "url", "historic", F.when(F.size(both) > 0, both).otherwise(F.coalesce("only", none)).alias("operators"))


def match_atlas(catalog: DataFrame, atlas: DataFrame) -> DataFrame:
    """feed_id, onestop_id, url, by_url: feeds (feed_id, provider, urls array) with an atlas feed that has any of their addresses, now
    or before; the others with one whose operator has their provider's name."""
    atlas = atlas.where(F.coalesce("url", F.lit("")) != "")
    places = atlas.select("onestop_id", "url", F.explode(F.array_union(F.array("url"), F.coalesce("historic", F.array().cast("array<string>")))).alias("any")).select("onestop_id", "url", norm_url(F.col("any")).alias("at"))
    wanted = catalog.select("feed_id", F.explode("urls").alias("any")).select("feed_id", norm_url(F.col("any")).alias("at")).where("at <> ''")
    by_url = wanted.join(places, "at").select("feed_id", "onestop_id", "url").distinct().withColumn("by_url", F.lit(True))
    names = atlas.select("onestop_id", "url", F.explode("operators").alias("name")).select("onestop_id", "url", norm_name(F.col("name")).alias("name")).where("name <> ''")
    rest = catalog.join(by_url, "feed_id", "left_anti").select("feed_id", norm_name(F.col("provider")).alias("name"))
    by_name = rest.join(names, "name").select("feed_id", "onestop_id", "url").distinct().withColumn("by_url", F.lit(False))
    return by_url.unionByName(by_name)


def feed_bbox(stops: DataFrame) -> DataFrame:
    box = F.struct(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    return stops.where("abs(lat) > 1 and abs(lon) > 1").groupBy("feed_id").agg(box.alias("bbox"))


def pick_fresh(stale: DataFrame, candidates: DataFrame, today: str, pad: float = 0.3) -> DataFrame:
    """Of ``candidates`` (feed_id, order, url, label, by_url, service_start, service_end, bbox) the first that reaches today and
    overlaps the box of the ``stale`` feed (feed_id, bbox); an unknown old box needs a match by address, a copy whose box is unknown passes."""
    old = stale.select("feed_id", F.col("bbox").alias("old"))
    both = candidates.join(old, "feed_id")
    o, b = F.col("old"), F.col("bbox")
    apart = (b["south"] > o["north"] + pad) | (b["north"] < o["south"] - pad) | (b["west"] > o["east"] + pad) | (b["east"] < o["west"] - pad)
    fits = F.when(o.isNull() | o["south"].isNull(), F.col("by_url")).otherwise(F.coalesce(~apart, F.lit(True)))
    ok = both.where((F.to_date("service_end") >= F.to_date(F.lit(today))) & fits)
    return ok.groupBy("feed_id").agg(F.min_by(F.struct("url", "label", "service_start", "service_end"), "order").alias("c")).select("feed_id", "c.*")


def atlas_extras(atlas: DataFrame, kept: DataFrame, ids: list[str]) -> DataFrame:
    """Atlas feeds of ``ids`` that no kept feed (onestop_id) is."""
    return atlas.where(F.col("onestop_id").isin(*ids)).join(kept, "onestop_id", "left_anti")


def union_candidates(*found: DataFrame) -> DataFrame:
    """Rows of all results by feed_id, the last result's where several have one."""
    out = None
    for i, df in enumerate(found):
        own = df.withColumn("_query", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("feed_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("feed_id", "_query")]), "_query").alias("r")).select("feed_id", "r.*")
