"""Clock times, dates, names, addresses and opening hours as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*\d+\s*$"), F.trim(c)).cast("int")


def parse_gtfs_time(text: Column) -> Column:
    """``H:MM:SS`` as seconds after midnight; hours may be 24 and over; null for anything else."""
    part = F.split(F.trim(text), ":")
    h, m, s = (_int(F.get(part, F.lit(i))) for i in range(3))
    return F.when(F.size(part) == 3, h * 3600 + m * 60 + s).cast("int")


def parse_gtfs_date(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{8}$"), F.try_to_date(F.trim(text), "yyyyMMdd"))


def next_weekday(day: Column, weekday: Column) -> Column:
    """The first date from ``day`` on with the weekday (Monday is 0)."""
    return F.date_add(day, F.pmod(weekday.cast("int") - F.weekday(day), F.lit(7)).cast("int"))


def norm_url(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", "")


def norm_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


def route_display_name(short: Column, long: Column, route_id: Column) -> Column:
    short, long = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (short, long))
    return F.coalesce(F.when(short.isNotNull() & long.isNotNull(), F.concat_ws(" ", short, long)), short, long, route_id)


def _clock(token: Column) -> Column:
    """Seconds after midnight of ``6am``, ``12:05 p.m.``."""
    hour, minute = F.regexp_extract(token, r"^\d+", 0).cast("int"), F.regexp_extract(token, r":(\d+)", 1)
    return F.pmod(hour, F.lit(12)) * 3600 + F.when(minute != "", minute.cast("int")).otherwise(0) * 60 + F.when(F.contains(token, F.lit("p")), 12 * 3600).otherwise(0)


def parse_hours(text: Column) -> Column:
    """All ``6:45am-5:12pm`` of a text, with ``: every 90 min`` or not, as [(start, end, headway)] in seconds; none: [].

    The text is read as a list of times, dashes, headways, digits and other words. Two times around a dash are a
    window; a headway after it belongs to it unless a digit stands between them.
    """
    plain = F.replace(F.lower(text), F.lit("\u2013"), F.lit("-"))
    tokens = F.regexp_extract_all(plain, F.lit(r"\d{1,2}(?::\d\d)?\s*[ap]\.?m\.?|every\s*\d+\s*min|-|\d|[a-z]+|\S"), F.lit(0))
    window = "struct<start:int,end:int,headway:int>"
    # from: the time before, dash: whether a dash follows it, open: whether the last window may still get a headway
    zero = F.struct(F.array().cast(f"array<{window}>").alias("found"), F.lit(None).cast("int").alias("from"), F.lit(False).alias("dash"), F.lit(False).alias("open"))

    def state(a: Column, **new: Column) -> Column:
        return F.struct(*[new.get(name, a[name]).alias(name) for name in ("found", "from", "dash", "open")])

    def step(a: Column, token: Column) -> Column:
        no, none = F.lit(False), F.lit(None).cast("int")
        ready = a["from"].isNotNull() & a["dash"]
        made = F.struct(a["from"].alias("start"), _clock(token).cast("int").alias("end"), none.alias("headway"))
        last = F.element_at(a["found"], -1)
        every = F.struct(last["start"].alias("start"), last["end"].alias("end"), (F.regexp_extract(token, r"\d+", 0).cast("int") * 60).alias("headway"))
        return (
            F.when(token.rlike(r"^\d.*m") & ready, state(a, found=F.concat(a["found"], F.array(made)), **{"from": none}, dash=no, open=F.lit(True)))
            .when(token.rlike(r"^\d.*m"), state(a, **{"from": _clock(token).cast("int")}, dash=no, open=no))
            .when(token == "-", state(a, dash=a["from"].isNotNull() & ~a["dash"]))
            .when(token.startswith("every") & token.endswith("min") & a["open"], state(a, found=F.concat(F.slice(a["found"], F.lit(1), F.size(a["found"]) - 1), F.array(every)), open=no))
            .otherwise(state(a, **{"from": none}, dash=no, open=a["open"] & ~token.rlike(r"\d")))
        )

    return F.coalesce(F.aggregate(tokens, zero, step, lambda a: a["found"]), F.array().cast(f"array<{window}>"))


def fmt_clock(seconds: Column) -> Column:
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds.cast("int"), F.lit(86400))
    clock = F.format_string("%02d:%02d", F.floor(rest / 3600).cast("int"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("int"))
    return F.concat(clock, F.when(day == 0, "").otherwise(F.format_string(" (%+dd)", day)))


def fmt_dur(seconds: Column) -> Column:
    whole = F.rint(seconds).cast("int")
    hours, minutes = F.floor(whole / 3600).cast("int"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("int")
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def chain_step(token: Column, default_agency: Column) -> Column:
    """``ROUTE`` or ``AGENCY:ROUTE`` as struct(agency, route): all before the last colon searches agencies; without one the default does."""
    at = F.instr(F.reverse(token), ":")
    agency = F.when(at > 0, F.substring(token, F.lit(1), F.length(token) - at)).otherwise(default_agency)
    return F.struct(agency.alias("agency"), F.when(at > 0, F.right(token, at - 1)).otherwise(token).alias("route"))


def named_by(route_name: Column) -> Column:
    """All names by which a step may call a route: the whole name, and its beginnings up to a blank; the case counts."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(route_name), F.lit(1))), lambda i: (i == F.length(route_name)) | F.substring(route_name, i + 1, F.lit(1)).rlike(r"\s"))
    return F.coalesce(F.array_distinct(F.transform(ends, lambda i: F.substring(route_name, F.lit(1), i))), F.array().cast("array<string>"))


def chain_step_matches(route_name: Column, agency: Column, step: str) -> Column:
    """Whether ``ROUTE`` or ``AGENCY:ROUTE`` names a route: its name is ROUTE or begins with it and a blank, and the agency regex is found, whatever its case, where there is one."""
    head, _, route = step.rpartition(":")
    named = F.array_contains(named_by(route_name), route)
    return named & F.coalesce(agency, F.lit("")).rlike(f"(?i){head}") if head else named
