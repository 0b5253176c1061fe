"""Given chains of routes: the least-cost way to ride each in its order, for many chains in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.checkpoint import cut, cut_dealt, dealt
from transit_spark.config import ROAD_MILE_NO_FREEWAY, Period, Prices, Walking
from transit_spark.functions.cost import ride_cost, walk_cost, walk_seconds
from transit_spark.functions.geo import distance, project
from transit_spark.functions.text import named_by
from transit_spark.operators.frequency import pool_edges
from transit_spark.operators.search import ROUNDS, Network, _States, best_routes
from transit_spark.operators.walks import _plane, pairs_within

#: Steps of the states before the first route and after the last one.
START, END = -1, 1 << 20


def chain_transfers(stops: DataFrame, nodes: DataFrame, radius: float, *keys: str) -> DataFrame:
    """keys, step, u, v, dist from stops (keys, step, node) of one step to those of the next within ``radius``; the same stop is at 0."""
    placed = stops.join(_plane(nodes), "node")
    left = placed.withColumnRenamed("node", "u")
    right = placed.withColumnRenamed("node", "v").withColumn("step", F.col("step") - 1)
    return pairs_within(left, right, radius, *keys, "step").select(*keys, "step", "u", "v", "dist")


def matched_patterns(patterns: DataFrame, steps: DataFrame) -> DataFrame:
    """chain_id, step, pattern_id of the patterns (pattern_id, route_name, agency) that a step (chain_id, step, route, agency) names: the route's name is the
    step's or begins with it and a blank, and the agency, where the step has one, is found in the pattern's whatever its case.
    Names are joined by their beginnings, so that no step meets all patterns."""
    names = patterns.select("pattern_id", F.col("agency").alias("_agency"), F.explode(named_by(F.col("route_name"))).alias("route"))
    both = steps.select("chain_id", "step", "route", "agency").join(names, "route")
    return both.where(F.col("agency").isNull() | F.expr("_agency rlike concat('(?i)', agency)")).select("chain_id", "step", "pattern_id").distinct()


def _state(step: Column, node: Column) -> Column:
    return F.struct(step.cast("int").alias("step"), node.cast("bigint").alias("node"))


def _ridden(patterns: DataFrame, rows: DataFrame, steps: DataFrame, classes: int, prices: Prices, period: Period) -> DataFrame:
    """chain_id, step, u, v, cost, time, freq, miles: the pooled rides between the stops of each step, the cheapest of two stops; and a row with no v for every
    stop. Dealt and sorted by chain_id, step and u, so that a search moves only its states. ``rows`` (pattern_id, pos, node, board, alight, freq, dep_med, arr_med,
    miles, told) meet once a pattern, and a stop is sent with all its rides."""
    named = matched_patterns(patterns, steps).groupBy("pattern_id").agg(F.collect_list(F.struct("chain_id", "step")).alias("named"))
    on = lambda a: (a["board"] & a["told"] & (a["freq"] > 0))
    off = lambda a: lambda b: on(a) & b["alight"] & b["told"] & (b["pos"] > a["pos"]) & (b["node"] != a["node"])
    ride = lambda a: lambda b: F.struct(b["node"].alias("v"), F.greatest(b["arr_med"] - a["dep_med"], F.lit(30.0)).cast("double").alias("time"), F.zip_with(b["miles"], a["miles"], lambda m1, m0: m1 - m0).alias("miles"))
    each = F.transform("s", lambda a: F.struct(a["node"].alias("u"), a["freq"].alias("freq"), F.transform(F.filter("s", off(a)), ride(a)).alias("rides")))
    whole = rows.groupBy("pattern_id").agg(F.collect_list(F.struct("pos", "node", "board", "alight", "freq", "dep_med", "arr_med", "miles", "told")).alias("s")).join(named, "pattern_id")
    served = whole.select("named", each.alias("s")).where(F.exists("s", lambda a: F.size(a["rides"]) > 0))
    sent = served.select("s", F.explode("named").alias("n")).select("n.chain_id", "n.step", F.explode("s").alias("a")).select("chain_id", "step", "a.u", "a.freq", "a.rides")
    sent = dealt(sent, "chain_id", "step", "u", rows=rows.count())
    pooled = pool_edges(sent.select("chain_id", "step", "u", "freq", F.explode_outer("rides").alias("r")).select("chain_id", "step", "u", "freq", "r.*"), classes, ("chain_id", "step"))
    pooled = pooled.withColumns({"freq": F.bround("freq", 2), "miles": F.array(*[F.col(f"miles_{k}") for k in range(classes)])})
    cost = ride_cost(F.col("time"), F.col("freq"), [F.col("miles")[k] for k in range(classes)], None, prices, period)
    best = pooled.where("v is null or freq > 0").withColumn("cost", cost).groupBy("chain_id", "step", "u", "v").agg(F.min_by(F.struct("cost", "time", "freq", "miles"), F.struct("cost", -F.col("freq"))).alias("r"))
    return cut_dealt(best.select("chain_id", "step", "u", "v", "r.*").sortWithinPartitions("chain_id", "step", "u"))


def evaluate_chains(patterns: DataFrame, pattern_stops: DataFrame, freq: DataFrame | None, profile: DataFrame | None, miles: DataFrame | None, nodes: DataFrame, steps: DataFrame, places: DataFrame,
                    prices: Prices = Prices(), transfer_walk: float = 800.0, access_walk: float = 800.0, period: Period = Period(), walking: Walking = Walking()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends: chain_id, cost, bottleneck, rides; legs: chain_id, leg_no, kind, u, v, time, freq, dist, miles; problems: chain_id, problem) of the least-cost way
    to ride the routes of each chain in order, between its places (chain_id, role: origin or destination, lat, lon).

    ``steps``: chain_id, step from 0, route, agency (a pattern to search for, or null). ``miles`` (pattern_id, pos, miles) has as many classes as
    ``prices.mile``; where ``freq``, ``profile`` and ``miles`` are None, ``pattern_stops`` has their columns. The network of all chains is one product graph: a
    state is a step and a node, rides of a step's route lead to states of the same step, walks of ``transfer_walk`` metres at most to the next one. Walks
    lead from place to place, however many stops are there. A step may be ridden none, once or more times.
    States keep where they came from, so a way's length doesn't matter. A chain with problems has no end.
    """
    classes = len(prices.mile)
    steps = cut(steps.select("chain_id", "step", "route", "agency"))
    rows = pattern_stops.withColumn("told", F.lit(True))
    if freq is not None:
        told = profile.join(miles.select("pattern_id", "pos", "miles"), ["pattern_id", "pos"]).withColumn("told", F.lit(True))
        rows = pattern_stops.join(told, ["pattern_id", "pos"], "left").join(freq, ["pattern_id", "pos"], "left").withColumn("told", F.coalesce("told", F.lit(False)))
    rides = _ridden(patterns, rows, steps, classes, prices, period)
    stops = rides.select("chain_id", "step", F.col("u").alias("node")).distinct()
    at = cut_dealt(dealt(cut(stops.join(_plane(nodes), "node")), "chain_id", "step", "node").sortWithinPartitions("chain_id", "step", "node"))
    last = steps.groupBy("chain_id").agg(F.max("step").alias("last"))
    xy = project(F.col("lat"), F.col("lon"))
    placed = places.select("chain_id", "role", xy[0].alias("px"), xy[1].alias("py")).join(last, "chain_id").withColumn("step", F.when(F.col("role") == "origin", 0).otherwise(F.col("last")))
    near = at.join(placed, ["chain_id", "step"]).withColumn("dist", distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("dist") <= access_walk)
    near = cut(near.groupBy("chain_id", "role", "step", "node").agg(F.min("dist").alias("dist")))

    missing = steps.join(stops.select("chain_id", "step").distinct(), ["chain_id", "step"], "left_anti")
    problems = missing.select("chain_id", F.concat(F.lit("no service found for route "), "route", F.coalesce(F.concat(F.lit(" ("), "agency", F.lit(")")), F.lit(""))).alias("problem"))
    whole = last.join(missing.select("chain_id").distinct(), "chain_id", "left_anti")
    sides = whole.join(F.broadcast(steps.sparkSession.createDataFrame([(0, "origin", "start"), (1, "destination", "end")], "n int, role string, side string")))
    far = sides.join(near.select("chain_id", "role").distinct(), ["chain_id", "role"], "left_anti").withColumn("step", F.when(F.col("n") == 0, 0).otherwise(F.col("last"))).join(steps, ["chain_id", "step"])
    far = far.groupBy("chain_id").agg(F.min_by(F.struct("route", "side"), "n").alias("f")).select("chain_id", F.concat(F.lit("no stop of route "), "f.route", F.lit(f" within {access_walk:.0f} m of the "), "f.side").alias("problem"))
    problems = cut(problems.unionByName(far))

    start = cut(whole.join(problems.select("chain_id").distinct(), "chain_id", "left_anti"))
    near = cut(near.join(start.select("chain_id"), "chain_id", "left_semi"))
    best = cut(_settled(near, rides.where("v is not null"), at, transfer_walk, prices, walking))
    end = best.where(F.col("node.step") == END)
    lost = start.join(end.select("chain_id"), "chain_id", "left_anti").select("chain_id", F.lit("the routes do not connect in this order within the transfer walk limit").alias("problem"))
    here, hops, back = end.select("chain_id", "node"), [], 0
    while True:
        hop = cut(here.join(best, ["chain_id", "node"]).select("chain_id", F.lit(back).alias("back"), F.col("from").alias("a"), F.col("node").alias("b")))
        hops.append(hop)
        if hop.isEmpty():
            break
        here, back = hop.select("chain_id", F.col("a").alias("node")), back + 1
    hops = cut(reduce(DataFrame.unionByName, hops))
    own = hops.where("a.step = b.step").select("chain_id", "back", F.col("a.step").alias("step"), F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    # Not as a fourth key of the join, for which all rides would be dealt anew.
    own = own.join(rides.withColumnRenamed("v", "to"), ["chain_id", "step", "u"]).where("v between to and to").select("chain_id", "back", F.lit("ride").alias("kind"), "u", "v", "time", "freq", F.lit(None).cast("double").alias("dist"), "miles")
    ends = hops.where(f"a.step = {START} or b.step = {END}").withColumns({"role": F.when(F.col("a.step") == START, "origin").otherwise("destination"), "node": F.when(F.col("a.step") == START, F.col("b.node")).otherwise(F.col("a.node"))})
    foot = ends.join(near, ["chain_id", "role", "node"]).select("chain_id", "back", F.col("node").alias("u"), F.col("node").alias("v"), "dist")
    spot = lambda of: at.select("chain_id", *[F.col(c).alias(f"{c}{of}") for c in ("step", "node", "x", "y")])
    links = hops.where(f"a.step > {START} and b.step < {END} and a.step < b.step").select("chain_id", "back", *[F.col(f"{of}.{c}").alias(f"{c}{of}") for of in "ab" for c in ("step", "node")])
    links = links.join(spot("a"), ["chain_id", "stepa", "nodea"]).join(spot("b"), ["chain_id", "stepb", "nodeb"])
    foot = foot.unionByName(links.select("chain_id", "back", F.col("nodea").alias("u"), F.col("nodeb").alias("v"), distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")).alias("dist")))
    foot = foot.select("chain_id", "back", F.lit("walk").alias("kind"), "u", "v", walk_seconds(F.col("dist"), walking).alias("time"), F.lit(None).cast("double").alias("freq"), "dist", F.lit(None).cast("array<double>").alias("miles"))
    place = F.row_number().over(W.partitionBy("chain_id").orderBy(F.desc("back")))
    legs = cut(own.unionByName(foot).withColumn("leg_no", place).select("chain_id", "leg_no", "kind", "u", "v", "time", "freq", "dist", "miles"))
    ridden = legs.where("kind = 'ride'").groupBy("chain_id").agg(F.min("freq").alias("bottleneck"), F.count("*").alias("rides"))
    out = end.select("chain_id", F.col("label").alias("cost")).join(ridden, "chain_id", "left").withColumn("rides", F.coalesce("rides", F.lit(0)))
    return out, legs, problems.unionByName(lost)


def _walk_cost(prices: Prices, walking: Walking) -> Column:
    """Of ``dist``."""
    return F.greatest(walk_cost(walk_seconds(F.col("dist"), walking), F.col("dist"), F.lit(0.0), prices), F.lit(1.0))


def _settled(near: DataFrame, rides: DataFrame, at: DataFrame, transfer_walk: float, prices: Prices, walking: Walking) -> DataFrame:
    """chain_id, node (a state), label, from: the least cost of every state from its chain's start. ``near``: chain_id, role, step, node, dist of the stops
    near a chain's places; ``rides``: chain_id, step, u, v, cost; ``at``: chain_id, step, node, x, y of the stops."""
    paid, outer = _walk_cost(prices, walking), F.lit(0)
    spot = at.select("x", "y").distinct()
    links = pairs_within(spot.select("x", "y", F.col("x").alias("ux"), F.col("y").alias("uy")), spot.select("x", "y", F.col("x").alias("vx"), F.col("y").alias("vy")), transfer_walk)
    links = cut(links.select(F.col("ux").alias("x"), F.col("uy").alias("y"), "vx", "vy", paid.alias("cost")))
    stops = cut_dealt(dealt(at, "chain_id", "x", "y").sortWithinPartitions("chain_id", "x", "y"))
    state = lambda step, node: _state(F.col(step), F.col(node))
    first = near.where("role = 'origin'").select(F.col("chain_id").alias("query_id"), state("step", "node").alias("node"), F.lit(0).alias("layer"), paid.alias("label"), _state(F.lit(START), outer).alias("from"))
    goal = near.where("role = 'destination'").select("chain_id", "step", "node", paid.alias("cost"))
    front = cut(first)
    states = _States(front, high=False)
    for _ in range(ROUNDS):
        old = front.select(F.col("query_id").alias("chain_id"), F.col("node.step").alias("step"), F.col("node.node").alias("node"), "label")
        after = lambda df, to: df.select("chain_id", to.alias("node"), F.struct((F.col("label") + F.col("cost")).alias("label"), state("step", "node").alias("from")).alias("s"))
        ridden = after(old.join(rides.withColumnRenamed("u", "node"), ["chain_id", "step", "node"]), state("step", "v"))
        ended = after(old.join(goal, ["chain_id", "step", "node"]), _state(F.lit(END), outer))
        # On foot: the best stop of each place, then the best place around each place, then all stops there.
        left = old.join(at, ["chain_id", "step", "node"]).groupBy("chain_id", "step", "x", "y").agg(F.min(F.struct("label", "node")).alias("s"))
        left = left.select("chain_id", "step", "x", "y", "s.*").join(links, ["x", "y"])
        left = left.groupBy("chain_id", (F.col("step") + 1).alias("step"), F.col("vx").alias("x"), F.col("vy").alias("y")).agg(F.min(F.struct((F.col("label") + F.col("cost")).alias("label"), state("step", "node").alias("from"))).alias("s"))
        walked = left.join(stops, ["chain_id", "x", "y", "step"]).select("chain_id", state("step", "node").alias("node"), "s")
        new = ridden.unionByName(walked).unionByName(ended).groupBy(F.col("chain_id").alias("query_id"), F.col("node").alias("_b")).agg(F.min("s").alias("s"))
        front = cut(states.fresh(new.select("query_id", F.col("_b").alias("node"), F.lit(0).alias("layer"), "s.label", "s.from")))
        if front.isEmpty():
            return states.all().groupBy(F.col("query_id").alias("chain_id"), "node").agg(F.min(F.struct("label", "from")).alias("s")).select("chain_id", "node", "s.label", "s.from")
        states.add(front)
    raise RuntimeError("evaluate_chains: not settled")


def compare_chains(g: Network, pairs: DataFrame, max_walk: float = 800.0) -> tuple[DataFrame, DataFrame]:
    """(routes, legs) of the way between the places of each of ``pairs`` (query_id, origin, destination), at any frequency, with the fewest miles of the
    least local class: what a given chain is compared with."""
    return best_routes(g, pairs.withColumn("threshold", F.lit(0.0)), Prices(mile=ROAD_MILE_NO_FREEWAY), max_walk)
