"""Cross-session analytics over the long table (session_id, start_ts, signal, group, mean)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.operators.ordered import Series, group_medians, null_safe_join
from laminaflow.operators.slopes import theil_sen

ORDER = ["start_ts", "session_id"]


def _confidence(n: Column, effect: Column) -> Column:
    return F.least(F.lit(0.95), 0.35 + 0.08 * n + F.abs(effect) / 200)


def _means(stats: DataFrame) -> DataFrame:
    return stats.where("mean is not null")


def _labels(stats: DataFrame) -> DataFrame:
    """Signal -> group of its first session that names one."""
    return stats.where("group <> ''").groupBy("signal").agg(F.min_by("group", F.struct(*ORDER)).alias("group"))


def signal_trends(stats: DataFrame, min_pct: float = 5.0) -> DataFrame:
    """Signals whose session mean drifts by at least ``min_pct`` of its level per session, by the median of all pairwise slopes."""
    means = _means(stats)
    level = means.groupBy("signal").agg(F.avg("mean").alias("mean_overall"))
    df = theil_sen(means, ["signal"], ORDER, "mean").where("n >= 3").join(level, "signal")
    pct = F.abs(F.col("slope") / F.col("mean_overall") * 100)
    df = df.where(F.abs("mean_overall") >= 1e-9).withColumn("slope_pct_of_mean", pct).where(
        F.col("slope_pct_of_mean") >= min_pct)
    return df.join(_labels(stats), "signal", "left").select(
        F.lit("trend").alias("type"), "signal", "group",
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        F.col("slope").alias("slope_per_session"), "slope_pct_of_mean", F.col("n").alias("n_sessions"),
        "mean_overall", _confidence(F.col("n"), F.col("slope_pct_of_mean")).alias("confidence")).orderBy(F.desc("confidence"), "signal")


def before_after(stats: DataFrame, events: DataFrame, window: int = 5, min_pct: float = 20.0, on: Sequence[str] = ()) -> DataFrame:
    """Mean level in the last ``window`` sessions before and the first after each event, per signal.

    With ``on`` (the machine, say) an event only asks about the signals of its own machine.

    The positions are found by one merged ordering instead of a theta join: sessions and events of a signal are
    unioned, a running count gives every event the number of sessions before it, and an equi-join on
    (signal, position) fetches exactly the 2*window neighbours. events(event_id, event_ts, event_type).
    """
    means = _means(stats).where("start_ts is not null")
    s = Series(means, ["signal"], ORDER).with_row_number("pos")
    numbered = s.frame.select("signal", "pos", "mean", "start_ts")
    keys = list(on) or ["_all"]
    known = means if on else means.withColumn("_all", F.lit(0))
    asking = events if on else events.withColumn("_all", F.lit(0))
    asks = asking.where("event_ts is not null").select("event_id", "event_ts", "event_type", *keys).join(known.select(*keys, "signal").distinct(), keys)
    merged = means.select("signal", F.col("start_ts").alias("ts"), F.lit(1).alias("_is_session"),
                          F.col("session_id").alias("_tie"), F.lit(None).cast("string").alias("event_type"),
                          F.lit(None).cast(asks.schema["event_id"].dataType).alias("event_id"))
    asked = asks.select("signal", F.col("event_ts").alias("ts"), F.lit(0).alias("_is_session"),
                        F.col("event_id").cast("string").alias("_tie"), "event_type", "event_id")
    # an event sorts in front of a session with the same stamp: that session counts as after
    both = Series(merged.withColumn("_tie", F.col("_tie").cast("string")).unionByName(asked), ["signal"],
                  ["ts", "_is_session", "_tie"]).with_running_sum("_before", F.col("_is_session"))
    placed = both.frame.where("_is_session = 0").select("signal", "event_id", "event_type", "ts", "_before")
    near = F.sequence(F.greatest(F.lit(1), F.col("_before") - window + 1), F.col("_before") + window)
    wanted = placed.withColumn("pos", F.explode(near)).join(numbered, ["signal", "pos"])
    past = F.col("pos") <= F.col("_before")
    agg = wanted.groupBy("signal", "event_id", "event_type", F.col("ts").alias("event_ts")).agg(
        F.avg(F.when(past, F.col("mean"))).alias("before_mean"), F.avg(F.when(~past, F.col("mean"))).alias("after_mean"),
        F.count_if(past).alias("n_before"), F.count_if(~past).alias("n_after"))
    # the threshold applies to the published, one-decimal percentage
    pct = F.round((F.col("after_mean") - F.col("before_mean")) / F.abs("before_mean") * 100, 1)
    agg = agg.where("n_before >= 1 and n_after >= 1").where(F.abs("before_mean") >= 1e-9).withColumn(
        "delta_pct", pct).where(F.abs("delta_pct") >= min_pct)
    return agg.join(_labels(stats), "signal", "left").select(
        F.lit("before_after").alias("type"), "event_id", "event_type", "event_ts", "signal", "group", "before_mean",
        "after_mean", "delta_pct", "n_before", "n_after",
        _confidence(F.col("n_before") + F.col("n_after"), F.col("delta_pct")).alias("confidence")).orderBy(F.desc(F.abs("delta_pct")), "event_id", "signal")


def session_outliers(stats: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Sessions whose mean is far from the median of all sessions of the signal."""
    means = _means(stats)
    med = group_medians(means, ["signal"], "mean", "med")
    dev = means.join(med, "signal").withColumn("_dev", F.abs(F.col("mean") - F.col("med")))
    mad = group_medians(dev, ["signal"], "_dev", "mad")
    base = dev.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.max("_dev").alias("_far"),
                                     F.avg("mean").alias("baseline_mean")).where("n >= 3")
    df = dev.join(base, "signal").join(mad, "signal")
    off = F.col("mean") - F.col("med")
    z = F.when(F.col("mad") > 0, 0.6745 * off / F.col("mad")).when(F.col("_far") > 0, off / (F.col("_far") / 10)).otherwise(0.0)
    df = df.withColumn("z_score", z).where(F.abs("z_score") >= threshold)
    return df.drop("group").join(_labels(stats), "signal", "left").select(
        F.lit("session_anomaly").alias("type"), "session_id", "signal", "group", F.col("mean").alias("value"),
        "baseline_mean", "z_score", F.when(F.col("z_score") > 0, "high").otherwise("low").alias("direction"),
        F.least(F.lit(0.90), 0.4 + F.abs("z_score") / 10).alias("confidence")).orderBy(F.desc(F.abs("z_score")), "session_id", "signal")


#: Sessions that one exact search takes at once; longer signals are searched in tiles first.
TILE = 1 << 14


def best_cuts(points: Column, penalty: Column, min_size: int) -> Column:
    """Cuts of the cheapest segmentation: squared deviations from the segments' means, and ``penalty`` for every segment.

    ``points`` is an ascending array of (t, s, q): the places where a segment may begin or end, the first and the last
    one being the ends of the series, with the sums and sums of squares of the values before them. Exact over these
    places: the best cost up to each is the least over all earlier ones that can still pay; of equal costs the earliest
    place counts.
    """
    def start(p: Column, best: Column) -> Column:
        return F.struct(p["t"].alias("t"), p["s"].alias("s"), p["q"].alias("q"), best.alias("best"), F.lit(1 << 62).alias("until"))

    def step(state: Column, x: Column) -> Column:
        """Costs of a segment from every start that is left to ``x``."""
        def cost(p: Column) -> Column:
            size, total = x["t"] - p["t"], x["s"] - p["s"]
            c = F.when(size >= min_size, p["best"] + F.greatest(x["q"] - p["q"] - F.try_divide(total * total, size), F.lit(0.0))).otherwise(float("inf"))
            return F.struct(p.alias("p"), c.alias("c"))

        return F.struct(state["ways"].alias("ways"), F.transform(F.filter(state["starts"], lambda p: p["until"] > x["t"]), cost).alias("to"))

    def grown(state: Column, x: Column) -> Column:
        least = F.array_min(F.transform(state["to"], lambda o: o["c"]))
        came = F.get(F.filter(state["to"], lambda o: o["c"] == least), F.lit(0))["p"]["t"]
        # a start that is worse than beginning anew here never pays again, once a segment may end that begins here
        kept = F.transform(state["to"], lambda o: o["p"].withField("until", F.when((o["c"] < float("inf")) & (o["c"] > least + penalty), F.least(o["p"]["until"], x["t"] + min_size)).otherwise(o["p"]["until"])))
        return F.struct(F.concat(kept, F.array(start(x, least + penalty))).alias("starts"), F.concat(state["ways"], F.array(F.struct(x["t"].alias("t"), came.alias("came")))).alias("ways"))

    origin = F.get(points, F.lit(0))
    first = F.struct(F.array(start(origin, -penalty)).alias("starts"), F.array(F.struct(origin["t"].alias("t"), origin["t"].alias("came"))).alias("ways"))
    done = F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), first, lambda state, x: _with(step(state, x), lambda st: grown(st, x)))
    ways = F.reverse(done["ways"])
    back = F.struct(F.element_at(points, -1)["t"].alias("t"), F.array().cast("array<long>").alias("cuts"))

    def walk(state: Column, x: Column) -> Column:
        return F.when((x["t"] == state["t"]) & (x["came"] > origin["t"]), F.struct(x["came"].alias("t"), F.concat(F.array(x["came"]), state["cuts"]).alias("cuts"))).otherwise(state)

    return F.aggregate(ways, back, walk)["cuts"]


def _with(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def change_points(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, label: str, min_size: int = 2, jump: int = 5, penalty: float = 3.0, tile: int = TILE) -> DataFrame:
    """(keys, pos, label, prev, level_before, level_after, n) of the cuts of every series.

    Least squares with a penalty of ``penalty`` variances per segment. ``pos`` is the 0-based place of the first row
    behind the cut and ``label`` that row's; ``prev`` the cut before or 0. ``level_before`` is the mean from there to the
    cut, ``level_after`` the mean of all that follows. Cuts stand at multiples of ``jump``. Up to ``tile`` rows of a key
    the cuts are those of least cost. Longer series are searched in tiles, twice with the borders moved by half a tile and
    for a quarter of the penalty, and the cuts found are the places of a last exact search over the whole series. Sums run
    before the rows are packed, so what is packed are grid points, not rows.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    clean = series.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, label]), v.alias("_v"))
    facts = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_var"))
    centred = null_safe_join(clean, facts, keys).withColumn("_d", F.col("_v") - F.col("_m"))
    s = Series(centred, keys, order).with_running_sums({"_rn": F.lit(1).cast("long"), "_s": F.col("_d"), "_q": F.col("_d") * F.col("_d")})
    d = F.col("_d")
    begin = F.struct((F.col("_rn") - 1).alias("t"), (F.col("_s") - d).alias("s"), (F.col("_q") - d * d).alias("q"), F.col(label).alias("label"))
    end = F.struct(F.col("_rn").alias("t"), F.col("_s").alias("s"), F.col("_q").alias("q"), F.lit(None).cast(series.schema[label].dataType).alias("label"))
    facts_of = ["_n", "_m", "_var"]
    points = s.frame.select(*keys, *facts_of, F.explode(F.when(F.col("_rn") == F.col("_n"), F.array(begin, end)).otherwise(F.array(begin))).alias("x"))
    t, half = F.col("x.t"), tile // 2
    cool = F.col("_n") <= tile
    shifts = list(enumerate((0, half)))
    border = reduce(lambda x, y: x | y, [(t + off) % tile == 0 for _, off in shifts])
    places = points.where((t == 0) | (t == F.col("_n")) | ((t % jump == 0) & (t >= min_size)) | (~cool & border))
    of = lambda k, tile_no: F.struct(F.lit(k).alias("kind"), tile_no.cast("long").alias("tile"))
    tiles = F.when(cool, F.array(of(0, F.lit(0)))).otherwise(F.array_compact(F.array(
        *[of(k, F.floor((t + off) / tile)) for k, off in shifts],
        # a tile's first place is the last of the one before
        *[F.when((t + off) % tile == 0, of(k, F.floor((t + off) / tile) - 1)) for k, off in shifts])))
    packed = places.withColumn("_in", F.explode(tiles)).groupBy(*keys, *facts_of, "_in.kind", "_in.tile").agg(F.array_sort(F.collect_list("x")).alias("_p"))
    charge = F.lit(penalty) * F.when(F.col("_var") == 0, 1e-12).otherwise(F.col("_var"))

    def chosen(penalty: Column) -> Column:
        return _with(best_cuts(F.col("_p"), penalty, min_size), lambda c: F.filter("_p", lambda p: F.array_contains(c, p["t"]) | (p["t"] == 0) | (p["t"] == F.col("_n"))))

    some = packed.select(*keys, *facts_of, chosen(F.when(cool, charge).otherwise(charge / 4)).alias("_p"))
    again = some.groupBy(*keys, *facts_of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p")))).alias("_p"))
    again = again.withColumn("_p", chosen(charge))
    cuts = again.select(*keys, *facts_of, F.explode(_triples(F.col("_p"))).alias("c"))
    before = (F.col("c.b.s") - F.col("c.a.s")) / (F.col("c.b.t") - F.col("c.a.t"))
    after = (F.col("c.z.s") - F.col("c.b.s")) / (F.col("c.z.t") - F.col("c.b.t"))
    return cuts.select(*keys, F.col("c.b.t").alias("pos"), F.col("c.b.label").alias(label), F.col("c.a.t").alias("prev"), (F.col("_m") + before).alias("level_before"),
                       (F.col("_m") + after).alias("level_after"), F.col("_n").alias("n"))


def _triples(points: Column) -> Column:
    """(a: the point before, b: the point, z: the last point) of all inner points."""
    inner = F.when(F.size(points) > 2, F.sequence(F.lit(2), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda i: F.struct(F.element_at(points, i - 1).alias("a"), F.element_at(points, i).alias("b"), F.element_at(points, -1).alias("z")))


def signal_shifts(stats: DataFrame, min_pct: float = 10.0, min_sessions: int = 6, min_size: int = 2, jump: int = 5) -> DataFrame:
    """Step changes of the session mean, at the change points of the signal; ``jump`` is the grid of candidate positions."""
    found = change_points(_means(stats), ["signal"], ORDER, "mean", "session_id", min_size, jump).where(F.col("n") >= min_sessions)
    found = found.withColumnsRenamed({"pos": "session_index", "n": "n_sessions", "session_id": "at_session"})
    pct = F.abs((F.col("level_after") - F.col("level_before")) / F.col("level_before") * 100)
    found = found.where(F.abs("level_before") >= 1e-9).withColumn("jump_pct", pct).where(F.col("jump_pct") >= min_pct)
    return found.join(_labels(stats), "signal", "left").select(
        F.lit("shift").alias("type"), "signal", "group",
        F.when(F.col("level_after") > F.col("level_before"), "up").otherwise("down").alias("direction"),
        "at_session", "session_index", "level_before", "level_after", "jump_pct", "n_sessions",
        _confidence(F.col("n_sessions"), F.col("jump_pct")).alias("confidence")).orderBy(F.desc("confidence"), "signal", "session_index")


def cross_session_findings(stats: DataFrame, events: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """All four detectors in one table."""
    parts = [signal_trends(stats), before_after(stats, events, on=on), session_outliers(stats), signal_shifts(stats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("findings"), F.max("confidence").alias("best_confidence"))


def maintenance_forecast(stats: DataFrame, thresholds: DataFrame, min_sessions: int = 4,
                         min_rel_slope: float = 0.005, horizon: float = 200.0) -> DataFrame:
    """Sessions until the drifting mean of a signal reaches its alarm limit (0 when already past it)."""
    means = _means(stats)
    limits = thresholds.select("signal", "alarm_high", "alarm_low").where("alarm_high is not null or alarm_low is not null")
    level = means.groupBy("signal").agg(F.max_by("mean", F.struct(*ORDER)).alias("current_mean"),
                                        F.avg("mean").alias("_avg"))
    df = theil_sen(means, ["signal"], ORDER, "mean").where(F.col("n") >= min_sessions)
    df = df.join(level, "signal").join(limits, "signal")
    size = F.when(F.col("_avg") == 0, 1.0).otherwise(F.abs("_avg"))
    df = df.where(F.abs("slope") >= min_rel_slope * size)
    up = F.col("slope") > 0
    limit = F.when(up, F.col("alarm_high")).otherwise(F.col("alarm_low"))
    df = df.withColumn("threshold", limit).where("threshold is not null and slope <> 0")
    left = F.col("threshold") - F.col("current_mean")
    past = (up & (left <= 0)) | (~up & (left >= 0))
    df = df.withColumn("sessions_to_threshold", F.when(past, 0.0).otherwise(left / F.col("slope")))
    df = df.where(past | ((F.col("sessions_to_threshold") > 0) & (F.col("sessions_to_threshold") <= horizon)))
    return df.join(_labels(stats), "signal", "left").select(
        "signal", "group", F.when(up, "increasing").otherwise("decreasing").alias("direction"),
        F.col("slope").alias("slope_per_session"), "current_mean", "threshold",
        F.when(up, "alarm_high").otherwise("alarm_low").alias("threshold_kind"), "sessions_to_threshold",
        F.col("n").alias("n_sessions")).orderBy("sessions_to_threshold", "signal")


def stats_or_fallback(full: DataFrame, compact: DataFrame) -> DataFrame:
    """Full-resolution statistics where a session has any, else those of its stored short series."""
    spare = compact.join(full.select("session_id").distinct(), "session_id", "left_anti")
    return full.unionByName(spare, allowMissingColumns=True)
