"""Replay of routes against trip times: as-of joins leg by leg, for many start times at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.checkpoint import cut
from transit_spark.config import OnDemand
from transit_spark.operators.frequency import dominant_class

DAY = 86400


def serving_options(legs: DataFrame, pattern_stops: DataFrame, pattern_times: DataFrame, miles: DataFrame | None = None) -> DataFrame:
    """route_id, leg_no, pattern_id, trip_no, dep, arr of trips that serve a leg (route_id, leg_no, u, v): from the first position of u at
    which one may board and that has a later v to alight at, to the first such v. With ``miles`` (pattern_id, pos, miles, a cumulative
    array) only patterns stay whose most miles there are of the class that has most of the leg's (``miles`` of ``legs``), as
    rides of one class are pooled and priced together."""
    on = pattern_stops.where("board").select("pattern_id", F.col("node").alias("u"), F.col("pos").alias("i"))
    off = pattern_stops.where("alight").select("pattern_id", F.col("node").alias("v"), F.col("pos").alias("j"))
    both = legs.select("route_id", "leg_no", "u", "v").join(on, "u").join(off, ["pattern_id", "v"]).where("i < j")
    one = both.groupBy("route_id", "leg_no", "pattern_id").agg(F.min(F.struct("i", "j")).alias("p")).select("route_id", "leg_no", "pattern_id", "p.i", "p.j")
    if miles is not None:
        at = lambda p, name: miles.select("pattern_id", F.col("pos").alias(p), F.col("miles").alias(name))
        priced = legs.select("route_id", "leg_no", dominant_class(F.col("miles")).alias("cls"))
        own = one.join(at("i", "m0"), ["pattern_id", "i"]).join(at("j", "m1"), ["pattern_id", "j"]).join(priced, ["route_id", "leg_no"])
        one = own.where(dominant_class(F.zip_with("m1", "m0", lambda a, b: a - b)) == F.col("cls")).select("route_id", "leg_no", "pattern_id", "i", "j")
    # Both times of a trip come from one pass over the times of the patterns that serve a leg.
    ends = one.select("route_id", "leg_no", "pattern_id", F.explode(F.array(F.struct(F.col("i").alias("pos"), F.lit(True).alias("first")), F.struct(F.col("j").alias("pos"), F.lit(False).alias("first")))).alias("e")).select("route_id", "leg_no", "pattern_id", "e.*")
    timed = cut(ends).join(pattern_times.select("pattern_id", "pos", "trip_no", "dep", "arr"), ["pattern_id", "pos"])
    both = timed.groupBy("route_id", "leg_no", "pattern_id", "trip_no").agg(F.max(F.when(F.col("first"), F.col("dep"))).alias("dep"), F.max(F.when(~F.col("first"), F.col("arr"))).alias("arr"), F.count_if("first").alias("_on"), F.count_if(~F.col("first")).alias("_off"))
    return both.where("_on > 0 and _off > 0").drop("_on", "_off")


def next_trip(ready: DataFrame, options: DataFrame, keys: list[str]) -> DataFrame:
    """``ready`` (keys, route_id, leg_no, ready) with pattern_id, trip_no, off, dep, arr of the trip that arrives first.

    An option is a pattern of the leg: of the day before to two days after the ready time's day its first day with a
    departure not before it counts, and of that day's departures the earliest arrival; over all options the least
    arrival wins, of equal ones the latest departure. Each departure carries the best trip from then on, so that one
    sort of departures and ready times of an option finds it, and no ready time meets all departures. The day follows
    from the option's last departure, so a ready time is sent once an option.
    """
    own = ["route_id", "leg_no", "pattern_id"]
    trip = F.struct("arr", (-F.col("dep")).alias("neg"), "trip_no")
    best = F.min(trip).over(W.partitionBy(*own).orderBy(F.desc("dep")).rangeBetween(W.unboundedPreceding, W.currentRow))
    later = options.select(*own, F.col("dep").cast("bigint").alias("at"), F.lit(0).alias("ask"), best.alias("best"))
    last = options.groupBy(*own).agg(F.max(F.col("dep").cast("bigint")).alias("_last"))
    at = lambda day: (F.col("ready") - (F.floor(F.col("ready") / DAY) + day) * DAY).cast("bigint")
    first = F.coalesce(*[F.when(at(day) <= F.col("_last"), F.lit(day)) for day in (-1, 0, 1, 2)])
    days = ready.join(last, ["route_id", "leg_no"]).withColumn("_day", first).where("_day is not null").withColumn("off", ((F.floor(F.col("ready") / DAY) + F.col("_day")) * DAY).cast("bigint"))
    asked = days.select(*own, (F.col("ready") - F.col("off")).cast("bigint").alias("at"), F.lit(1).alias("ask"), F.struct(*keys, "off").alias("who"))
    both = later.withColumn("who", F.lit(None).cast(asked.schema["who"].dataType)).unionByName(asked.withColumn("best", F.lit(None).cast(later.schema["best"].dataType)))
    found = both.withColumn("t", F.last("best", ignorenulls=True).over(W.partitionBy(*own).orderBy(F.desc("at"), "ask").rowsBetween(W.unboundedPreceding, 0))).where("ask = 1 and t is not null")
    chosen = F.struct((F.col("t.arr") + F.col("off")).alias("arr"), (F.col("t.neg") - F.col("off")).alias("neg"), "pattern_id", F.col("t.trip_no").alias("trip_no"), "off")
    one = found.select(*own, "who.*", "t").groupBy(*keys, "route_id", "leg_no").agg(F.min(chosen).alias("b"))
    return one.select(*keys, "route_id", "leg_no", "b.pattern_id", "b.trip_no", "b.off", (-F.col("b.neg")).alias("dep"), "b.arr")


def flex_pickup(ready: DataFrame, windows: DataFrame, keys: list[str], demand: OnDemand = OnDemand()) -> DataFrame:
    """``ready`` (keys, zone_id, day0 weekday of the service day, ready) with the pickup: half the usual headway after the ready time or at the
    start of a window (zone_id, weekday, start, end, headway) of the service day, whichever is later, on the first of
    eight days on which that is within the window. As trips do, windows come again every day."""
    rows = ready.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("base", (F.floor(F.col("ready") / DAY) + F.col("d")) * DAY)
    both = rows.join(windows.withColumnRenamed("weekday", "day0"), ["zone_id", "day0"]).withColumn("pickup", F.greatest(F.col("ready") + demand.headway // 2, F.col("start") + F.col("base"))).where(F.col("pickup") <= F.col("end") + F.col("base"))
    return both.groupBy(*keys, "zone_id").agg(F.min("pickup").cast("bigint").alias("pickup"))


def _begun(starts: DataFrame, options: DataFrame) -> DataFrame:
    """The state of every start (route_id, t0): its time, whether a vehicle was ridden, and the trip on board."""
    none = {"on_pattern": options.schema["pattern_id"].dataType.simpleString(), "on_trip": "bigint", "on_off": "bigint"}
    return starts.select("route_id", "t0", F.col("t0").cast("bigint").alias("t"), F.lit(False).alias("rode"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def _leg(state: DataFrame, legs: DataFrame, options: DataFrame, windows: DataFrame, day0: int, slack: int) -> DataFrame:
    """route_id, t0, leg_no, kind, wait_from, dep, arr, rode, on_pattern, on_trip, on_off of ``state`` after one leg of its route; states without a trip have no row."""
    now = state.join(legs.select("route_id", "leg_no", "kind", "time", "zone_id"), "route_id")
    off = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("on_pattern", "on_trip", "on_off")]
    row = ["route_id", "t0", "leg_no", "kind", F.col("t").alias("wait_from")]
    spent = F.rint("time").cast("bigint")
    walk = now.where("kind = 'walk'").select(*row, F.col("t").alias("dep"), (F.col("t") + spent).alias("arr"), "rode", *off)
    rides = now.where("kind = 'ride'")
    caught = next_trip(rides.select("route_id", "t0", "leg_no", (F.col("t") + F.when(F.col("rode"), slack).otherwise(0)).alias("ready")), options, ["t0"])
    caught = caught.select("route_id", "t0", "arr", "dep", F.col("pattern_id").alias("on_pattern"), F.col("trip_no").cast("bigint").alias("on_trip"), F.col("off").alias("on_off"), F.lit(1).alias("rank"))
    stay = rides.where("on_trip is not null").select("route_id", "t0", "leg_no", "t", "on_off", F.col("on_pattern").alias("pattern_id"), F.col("on_trip").alias("trip_no")).join(options, ["route_id", "leg_no", "pattern_id", "trip_no"])
    stay = stay.where(F.col("dep") + F.col("on_off") >= F.col("t")).select("route_id", "t0", (F.col("arr") + F.col("on_off")).alias("arr"), (F.col("dep") + F.col("on_off")).alias("dep"), F.col("pattern_id").alias("on_pattern"), F.col("trip_no").cast("bigint").alias("on_trip"), "on_off", F.lit(0).alias("rank"))
    best = caught.unionByName(stay).groupBy("route_id", "t0").agg(F.min(F.struct("arr", "rank", "dep", "on_pattern", "on_trip", "on_off")).alias("b"))
    rode = rides.select(*row).join(best, ["route_id", "t0"]).select("route_id", "t0", "leg_no", "kind", "wait_from", "b.dep", "b.arr", F.lit(True).alias("rode"), "b.on_pattern", "b.on_trip", "b.on_off")
    flex = now.where("kind = 'flex'")
    picked = flex_pickup(flex.select("route_id", "t0", "zone_id", F.lit(day0).alias("day0"), F.col("t").alias("ready")), windows, ["route_id", "t0"]).select("route_id", "t0", "pickup")
    taken = flex.join(picked, ["route_id", "t0"]).select(*row, F.col("pickup").alias("dep"), (F.col("pickup") + spent).alias("arr"), F.lit(True).alias("rode"), *off)
    return walk.unionByName(rode).unionByName(taken)


def _after(step: DataFrame) -> DataFrame:
    return step.select("route_id", "t0", F.col("arr").alias("t"), "rode", "on_pattern", "on_trip", "on_off")


def replay(legs: DataFrame, options: DataFrame, windows: DataFrame, starts: DataFrame, day0: int = 2, slack: int = 120) -> DataFrame:
    """route_id, t0, leg_no, kind, wait_from, dep, arr: every route of ``legs`` (route_id, leg_no, kind, time, zone_id) from every start (route_id, t0).

    Once a vehicle was ridden, on demand or not, every ride needs ``slack`` seconds, also after a walk, unless one stays on the
    same trip, which wins if it arrives no later. A leg without a trip ends the replay of its start: such starts have no row from
    that leg on. The loop is over leg numbers, each for all routes and starts at once.
    """
    last = legs.agg(F.max("leg_no")).first()[0]
    if last is None:
        raise ValueError("replay: there are no legs")
    state, done = cut(_begun(starts, options)), None
    for n in range(1, last + 1):
        step = cut(_leg(state, legs.where(F.col("leg_no") == n), options, windows, day0, slack))
        done = step if done is None else done.unionByName(step)
        state = _after(step)
    return done.select("route_id", "t0", "leg_no", "kind", "wait_from", "dep", "arr")


def telling_starts(legs: DataFrame, options: DataFrame, step: int = 60, until: int = 2 * DAY - 60) -> DataFrame:
    """route_id, t0: of the starts every ``step`` seconds those after which another trip is caught first.

    All starts between two departures of the first ride catch the same trip, so the last of them stands for all: there are as many
    as departures. Where a route begins on demand, or has no ride, every start arrives at a time of its own and all are kept."""
    vehicle = legs.where("kind <> 'walk'").groupBy("route_id").agg(F.min(F.struct("leg_no", "kind")).alias("f")).select("route_id", F.col("f.leg_no").alias("first"), F.col("f.kind").alias("first_kind"))
    routes = legs.join(vehicle, "route_id", "left").groupBy("route_id", "first", "first_kind").agg(F.sum(F.when(F.col("leg_no") < F.col("first"), F.rint("time")).otherwise(0)).cast("bigint").alias("before"))
    by_trip = routes.where("first_kind = 'ride'")
    times = options.join(by_trip.withColumnRenamed("first", "leg_no"), ["route_id", "leg_no"]).select("route_id", "before", F.pmod("dep", F.lit(DAY)).alias("at"))
    ends = by_trip.select("route_id", "before", F.lit(DAY - 1).alias("at"))  # the day of a ready time ends here
    days = times.unionByName(ends).distinct().withColumn("day", F.explode(F.array(*[F.lit(d) for d in range(-(-until // DAY) + 2)])))
    last = days.select("route_id", (F.floor((F.col("at") + F.col("day") * DAY - F.col("before")) / step) * step).cast("int").alias("t0")).where(F.col("t0").between(0, until))
    rest = sweep(routes.where("first_kind is null or first_kind <> 'ride'"), step, until)
    return last.unionByName(by_trip.select("route_id", F.lit(until).alias("t0"))).unionByName(rest).distinct()


def route_profiles(legs: DataFrame, options: DataFrame, windows: DataFrame, day0: int = 2, slack: int = 120, step: int = 60) -> DataFrame:
    """``connection_profile`` of a ``replay`` of every start of two days, without replaying them all.

    Only ``telling_starts`` are replayed, and after each leg starts that are at the same time on the same trip go on as one,
    the latest: a leg has no more rows than departures, however many starts there are."""
    last = legs.groupBy("route_id").agg(F.max("leg_no").alias("end"))
    ends = None
    state = cut(_begun(telling_starts(legs, options, step), options))
    for n in range(1, (legs.agg(F.max("leg_no")).first()[0] or 0) + 1):
        done = cut(_leg(state, legs.where(F.col("leg_no") == n), options, windows, day0, slack).join(last, "route_id"))
        here = done.where(F.col("end") == n).groupBy("route_id", "arr").agg(F.max("t0").alias("dep")).select("route_id", "dep", "arr")
        ends = here if ends is None else ends.unionByName(here)
        state = _after(done.where(F.col("end") > n)).groupBy("route_id", "t", "rode", "on_pattern", "on_trip", "on_off").agg(F.max("t0").alias("t0"))
    if ends is None:
        raise ValueError("route_profiles: there are no legs")
    return pareto_connections(ends.where(F.col("dep") < DAY), ["route_id"])


def sweep(routes: DataFrame, step: int = 60, until: int = 2 * DAY - 60) -> DataFrame:
    """route_id, t0 for a start every ``step`` seconds over two days."""
    return routes.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(until), F.lit(step))).alias("t0"))


def pareto_connections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` (keys, dep, arr) after whose departure none arrives as early."""
    later = F.min("arr").over(W.partitionBy(*keys).orderBy(F.desc("dep"), "arr").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_m", later).where("_m is null or arr < _m").drop("_m")


def connection_profile(replayed: DataFrame, legs: DataFrame) -> DataFrame:
    """route_id, dep, arr: the latest start of each arrival among starts of the first day whose replay ends, without those that a later start beats."""
    last = legs.groupBy("route_id").agg(F.max("leg_no").alias("leg_no"))
    ends = replayed.join(last, ["route_id", "leg_no"]).groupBy("route_id", "arr").agg(F.max("t0").alias("dep"))
    return pareto_connections(ends.select("route_id", "dep", "arr").where(F.col("dep") < DAY), ["route_id"])


def itinerary_steps(replayed: DataFrame, start: int) -> DataFrame:
    """route_id, leg_no, step, begin, end of one start: a wait before each leg that has one, and the leg."""
    one = replayed.where(F.col("t0") == start)
    waits = one.where("dep > wait_from").select("route_id", "leg_no", F.lit("wait").alias("step"), F.col("wait_from").alias("begin"), F.col("dep").alias("end"))
    return waits.unionByName(one.select("route_id", "leg_no", F.col("kind").alias("step"), F.col("dep").alias("begin"), F.col("arr").alias("end")))


def fastest_connection(profile: DataFrame) -> DataFrame:
    return profile.groupBy("route_id").agg(F.min(F.struct((F.col("arr") - F.col("dep")).alias("duration"), "dep", "arr")).alias("c")).select("route_id", "c.dep", "c.arr", "c.duration")
