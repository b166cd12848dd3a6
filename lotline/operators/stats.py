"""Production statistics and flow analytics (inventory F1-F24).

Rows marked M in the survey declare the output columns but not the formula;
the formula used is stated in each docstring.  Every per-equipment or
per-route running value goes through ``frames.running_by_group`` so that one
hot equipment or route does not end up in a single task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lotline import frames
from lotline.functions.calendar import hours_between, seconds_between, shop_day

# Load-statistic state columns and the state -> column mapping.
LOAD_STATES = ("SETUP", "BUSY", "IDLERUN", "IDLE", "PM", "BM")
OTHER_STATE = "OTHER"  # hours of states outside the mapping
STATE_TO_LOAD = {"SETUP": "SETUP", "BUSY": "BUSY", "IDLE_RUN": "IDLERUN", "IDLE": "IDLE", "PM": "PM", "DOWN": "BM"}


def eqp_plan(track: DataFrame, keys: Sequence[str], ts: str = "TS", kind: str = "KIND",
             scenario: str = "BASE", version: int = 1) -> DataFrame:
    """one row per visit: ARRIVAL_TS, START_TS (first track-in), END_TS (last track-out).

    ``track`` holds events with ``kind`` in (arrive, in, out); a NULL equipment is '-'.
    An arrival opens a visit of its keys; the events up to the next arrival
    belong to it.  At one instant, an out closes the visit that is open before an
    arrival opens the next; without an open visit, the arrival comes first, so a
    visit may begin and end at one instant.  Whether a visit is open follows from
    the last instant with more arrivals than outs (open) or fewer (closed); as
    many of both leave it as it was.  An in at the instant of an arrival belongs
    to the new visit.  The events are shuffled once, by keys; keys with too many
    events for one task are cut into slices.
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) if c == "EQP_ID" else F.col(c) for c in keys]
    events = track.select(*k, F.col(ts).alias("_ts"), F.col(kind).alias("_k"))
    small, large = frames.by_size(events, keys)
    visits = _visits(small, keys, frames.running_within, track.schema[ts].dataType)
    if large is not None:
        visits = visits.unionByName(_visits(large, keys, frames.running_by_group, track.schema[ts].dataType))
    return visits.select(F.lit(scenario).alias("SCENARIO_ID"), F.lit(version).alias("VERSION_NO"), *keys, "ARRIVAL_TS", "START_TS", "END_TS")


def _visits(events: DataFrame, keys: Sequence[str], running: Callable[..., DataFrame], time: DataType) -> DataFrame:
    """The visits of events (keys, _ts, _k); ``running`` takes the running values by keys."""
    count = lambda x: F.count_if(F.col("_k") == x)
    at = events.groupBy(*keys, "_ts").agg(count("arrive").alias("_a"), count("in").alias("_i"), count("out").alias("_o"))
    turn = F.signum(F.col("_a") - F.col("_o"))
    at = running(at, keys, ["_ts"], {
        "_visit": ("sum", "_a"), "_last": ("max_before", F.when(turn != 0, F.struct("_ts", turn.alias("_turn"))))})
    both = F.coalesce(F.col("_last._turn") > 0, F.lit(False)) & (F.col("_a") > 0) & (F.col("_o") > 0)
    when = lambda c: F.when(c, F.col("_ts"))
    none = F.lit(None).cast(time)
    part = lambda visit, a, i, o: F.struct(visit.alias("_visit"), a.alias("_arrive"), i.alias("_in"), o.alias("_out"))
    visit = F.col("_visit")
    # arrivals of one instant beside the last open visits of their own
    earlier = F.when(F.col("_a") > 1, F.transform(F.sequence(visit - F.col("_a") + 1, visit - 1), lambda v: part(v, F.col("_ts"), none, none)))
    parts = F.concat(
        F.array(part(visit, when(F.col("_a") > 0), when(F.col("_i") > 0), when(F.col("_o") - both.cast("int") > 0))),
        F.when(both, F.array(part(visit - F.col("_a"), none, none, F.col("_ts")))).otherwise(F.array()),
        F.coalesce(earlier, F.array()))
    found = at.select(*keys, F.inline(parts))
    return found.groupBy(*keys, "_visit").agg(
        F.min("_arrive").alias("ARRIVAL_TS"), F.min("_in").alias("START_TS"), F.max("_out").alias("END_TS"))


def load_stat(intervals: DataFrame, eqp: str = "EQP_ID", start: str = "TS", end: str = "END_TS",
              state: str = "STATE", day_offset_hours: int = 0) -> DataFrame:
    """hours per equipment and shop day in each load state (NULL -> 0).

    Each interval is cut at day boundaries (``explode(sequence(days))``) so a
    long interval spreads over its days; the overlap with each day is summed
    and pivoted over the fixed state list.
    """
    mapping = F.create_map(*[F.lit(x) for kv in STATE_TO_LOAD.items() for x in kv])
    x = intervals.select(F.col(eqp).alias("EQP_ID"), F.col(start).alias("_s"), F.col(end).alias("_e"),
                         F.coalesce(F.try_element_at(mapping, F.col(state)), F.lit(OTHER_STATE)).alias("_state"))
    first = shop_day(F.col("_s"), day_offset_hours)
    last = shop_day(F.col("_e"), day_offset_hours)
    d = x.select("*", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))).alias("DAY"))
    day_end = F.timestamp_add("DAY", F.lit(1), F.col("DAY"))
    ov = seconds_between(F.greatest(F.col("_s"), F.col("DAY")), F.least(F.col("_e"), day_end))
    d = d.select("EQP_ID", "DAY", "_state", (ov / 3600.0).alias("_h")).where(F.col("_h") > 0)
    states = [*LOAD_STATES, OTHER_STATE]
    p = d.groupBy("EQP_ID", "DAY").pivot("_state", states).agg(F.sum("_h"))
    return p.select("EQP_ID", "DAY", *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in states])


def step_move(moves: DataFrame, day_col: Column) -> DataFrame:
    """per day, part, step, equipment: MOVE_QTY, HOT_QTY, RUN_HOUR, WAIT_HOUR, WEEK_NO (ISO)."""
    m = moves.withColumn("DAY", day_col)
    return m.groupBy("DAY", "PART_ID", "STEP_SEQ", "EQP_ID").agg(
        F.sum("QTY").alias("MOVE_QTY"), F.sum(F.when(F.col("HOT"), F.col("QTY")).otherwise(0.0)).alias("HOT_QTY"),
        F.sum("RUN_HOUR").alias("RUN_HOUR"), F.sum("WAIT_HOUR").alias("WAIT_HOUR"),
    ).withColumn("WEEK_NO", F.weekofyear("DAY"))


def weighted_tat(s: Column, q: Column) -> Column:
    """Weighted mean = weighted sum / qty, or the weighted sum itself when qty <= 0."""
    return F.when(q > 0, F.try_divide(s, q)).otherwise(s)


def cycle_time(moves: DataFrame, keys: Sequence[str] = ("PART_ID", "STEP_SEQ", "EQP_ID"), extra: Sequence[Column] = ()) -> DataFrame:
    """weighted TATs (total, wait, run) per key, the simple mean wait per lot, and further aggregates."""
    tat = F.col("RUN_HOUR") + F.col("WAIT_HOUR")
    more = [F.struct(*extra).alias("_more")] if extra else []
    g = moves.groupBy(*keys).agg(
        F.sum("QTY").alias("MOVE_QTY"), F.sum(tat * F.col("QTY")).alias("TOTAL_TAT_W"),
        F.sum(F.col("WAIT_HOUR") * F.col("QTY")).alias("WAIT_TAT_W"),
        F.sum(F.col("RUN_HOUR") * F.col("QTY")).alias("RUN_TAT_W"),
        F.sum("WAIT_HOUR").alias("WAIT_SUM"), F.count(F.lit(1)).alias("LOT_COUNT"), *more)
    q = F.col("MOVE_QTY")
    return g.select(*keys, "MOVE_QTY", "LOT_COUNT",
                    weighted_tat(F.col("TOTAL_TAT_W"), q).alias("TOTAL_TAT"),
                    weighted_tat(F.col("WAIT_TAT_W"), q).alias("WAIT_TAT"),
                    weighted_tat(F.col("RUN_TAT_W"), q).alias("RUN_TAT"),
                    F.try_divide(F.col("WAIT_SUM"), F.col("LOT_COUNT")).alias("SIMPLE_WAIT"), *(["_more.*"] if more else []))


def cycle_time_periodic(moves: DataFrame, day_col: Column) -> DataFrame:
    """F5 per day with loss counts and minutes, in one aggregate.

    Losses (our definition on the move rows): rework = HOT, scrap = QTY < 5,
    chuck = RUN_HOUR = 0, reticle = SETUP = 'O'.  The minutes of rework and scrap
    are those of their runs; chuck and reticle losses are waits.
    """
    losses = {"REWORK": (F.col("HOT"), "RUN_HOUR"), "SCRAP": (F.col("QTY") < 5, "RUN_HOUR"),
              "CHUCK": (F.col("RUN_HOUR") == 0, "WAIT_HOUR"), "RETICLE": (F.col("SETUP") == "O", "WAIT_HOUR")}
    extra = [F.count_if(lost).alias(f"{name}_CNT") for name, (lost, _) in losses.items()]
    extra += [F.sum(F.when(lost, F.col(hours) * 60).otherwise(0.0)).alias(f"{name}_MIN") for name, (lost, hours) in losses.items()]
    return cycle_time(moves.withColumn("DAY", day_col), ("DAY", "PART_ID", "STEP_SEQ"), extra)


def wip_over_time(moves: DataFrame, step: str, start: str, end: str, tie: Sequence[str]) -> DataFrame:
    """F8: +1 at track-in, -1 at track-out; WIP per step after each event (out before in at equal times)."""
    ins = moves.select(F.col(step).alias("STEP"), F.col(start).alias("TS"), F.lit(1).alias("KIND_ORDER"),
                       F.lit(1).alias("DELTA"), *tie)
    outs = moves.select(F.col(step).alias("STEP"), F.col(end).alias("TS"), F.lit(0).alias("KIND_ORDER"),
                        F.lit(-1).alias("DELTA"), *tie)
    ev = ins.unionByName(outs)
    return frames.running_by_group(ev, ["STEP"], ["TS", "KIND_ORDER", *tie], {"WIP": ("sum", "DELTA")})


def standby_gaps(moves: DataFrame, eqp: str, start: str, end: str, tie: Sequence[str]) -> DataFrame:
    """idle gaps between runs of an equipment after merging overlapping runs."""
    order = [start, *tie]
    r = frames.running_by_group(moves.select(eqp, start, end, *tie), [eqp], order, {"_free": ("max_before", end)})
    return r.where(F.col(start) > F.col("_free")).select(
        F.col(eqp).alias("EQP_ID"), F.col("_free").alias("GAP_START"), F.col(start).alias("GAP_END"),
        hours_between(F.col("_free"), F.col(start)).alias("GAP_HOURS"))


def qtime_check(events: DataFrame, lot: str, ts: str, tie: str, is_start: Column, is_end: Column,
                warn_hours: float, limit_hours: float) -> DataFrame:
    """for each start-step event, the nearest later end-step event of the same lot.

    QT = end - start; OK below warning, WARN up to the limit, OVER beyond,
    OPEN when no end follows.  The nearest end is an as-of lookup: a running
    minimum of end times in reverse time order per lot (skew-safe), not a
    pairwise join.
    """
    e = events.where(is_start | is_end).select(
        F.col(lot).alias("LOT_ID"), F.col(ts).alias("_t"), F.col(tie).alias("_tie"),
        F.when(is_end, F.col(ts)).alias("_end_ts"), is_start.alias("_is_start"))
    # at equal times starts come first in descending order: an end must be strictly later
    r = frames.running_by_group(e, ["LOT_ID"], [F.col("_t").desc(), F.col("_is_start").desc(), F.col("_tie").desc()],
                                {"_next_end": ("min", "_end_ts")})
    s = r.where(F.col("_is_start"))
    # the running minimum includes the row itself; a start row has no end time of its own
    qt = hours_between(F.col("_t"), F.col("_next_end"))
    status = (F.when(F.col("_next_end").isNull(), "OPEN").when(qt <= warn_hours, "OK")
              .when(qt <= limit_hours, "WARN").otherwise("OVER"))
    return s.select("LOT_ID", F.col("_t").alias("START_TS"), F.col("_tie").alias("START_EVENT"),
                    F.col("_next_end").alias("END_TS"), qt.alias("QT_HOURS"), status.alias("STATUS"))


def route_cumulative(route: DataFrame) -> DataFrame:
    """running yield (product via log-sum of amounts and a count of signs; 0 from the first zero on) and remaining cycle time."""
    y = F.col("YIELD")
    fwd = frames.running_by_group(route, ["ROUTE_ID"], ["STEP_SEQ"], {
        "_log_y": ("sum", F.when(y != 0, F.log(F.abs(y)))), "_minus": ("sum", F.when(y < 0, 1).otherwise(0)),
        "_zeros": ("sum", F.when(y == 0, 1).otherwise(0)), "CUM_CT": ("sum", "CT_HOUR")})
    both = frames.running_by_group(fwd, ["ROUTE_ID"], [F.col("STEP_SEQ").desc()],
                                   {"REMAIN_CT": ("sum", "CT_HOUR")})
    sign = F.when(F.col("_minus") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return both.withColumn("CUM_YIELD", F.when(F.col("_zeros") > 0, F.lit(0.0)).otherwise(sign * F.exp("_log_y"))).drop(
        "_log_y", "_zeros", "_minus")


def bom_explode(bom: DataFrame, root: int = 0) -> DataFrame:
    """all components under ``root`` with LEVEL and QTY_PER (product of ratios).

    Level-synchronous joins of the frontier with the edge list until the
    frontier is empty; each level is checkpointed to cut lineage.  A path longer
    than the number of parents runs in a cycle and raises.
    """
    edges = bom.select("PARENT", "CHILD", "RATIO")
    most = edges.select("PARENT").distinct().count()
    frontier = frames.checkpoint(edges.where(F.col("PARENT") == root).select(
        F.col("CHILD").alias("COMPONENT"), F.lit(1).alias("LEVEL"), F.col("RATIO").alias("QTY_PER")))
    levels = [frontier]
    while True:
        lvl = len(levels) + 1
        nxt = frames.checkpoint(frontier.join(edges, frontier["COMPONENT"] == edges["PARENT"]).select(
            "PARENT", F.col("CHILD").alias("COMPONENT"), F.lit(lvl).alias("LEVEL"),
            (F.col("QTY_PER") * F.col("RATIO")).alias("QTY_PER")))
        found = nxt.first()
        if found is None:
            break
        if lvl > most:
            raise ValueError(f"cycle in the bill of materials at {found['PARENT']} -> {found['COMPONENT']}")
        frontier = nxt.drop("PARENT")
        levels.append(frontier)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.select(F.lit(root).cast("bigint").alias("ROOT"), "COMPONENT", "LEVEL", "QTY_PER")


def fifo_peg(supply: DataFrame, demand: DataFrame, product: str, qty: str,
             supply_order: Sequence[str], demand_order: Sequence[str], bucket: float | None = None,
             exact: bool = False) -> DataFrame:
    """FIFO pegging of supply to demand per product.

    Quantities add up in decimals (six places) along each side; the ends of
    both sides cut a product's axis into segments, and each segment belongs to
    the first supply and the first demand that end at it or behind it, and
    begins where the later of both begins.  The merged cut points are one row
    per input row, whatever the quantities; one pass numbers and adds up both
    sides, and one finds the "first behind" as a running minimum in descending
    order (both skew-safe).  PEG_QTY is a double, or with ``exact`` the decimal,
    which adds up without rounding.  A quantity that is null or
    below zero raises; rows of quantity zero take a number and no peg.
    ``bucket`` has no effect; earlier callers may still give it.
    """
    kind = "decimal(28,6)"
    names = [f"_o{i}" for i in range(max(len(supply_order), len(demand_order)))]

    def side(df, order, tag):
        types = dict(df.dtypes)
        amount = F.col(qty).cast(kind)
        fault = F.concat(F.lit(f"{qty} must not be null or below zero, but is "), F.coalesce(F.col(qty).cast("string"), F.lit("null")))
        checked = F.when(F.coalesce(amount >= 0, F.lit(False)), amount).otherwise(F.raise_error(fault).cast(kind))
        return df.select(F.col(product).alias("PRODUCT"), F.lit(tag).alias("_side"), checked.alias("_q"),
                         *[(F.col(order[i]) if i < len(order) else F.lit(None)).alias(n) for i, n in enumerate(names)]), [types[c] for c in order]

    (s, s_types), (d, d_types) = side(supply, supply_order, "s"), side(demand, demand_order, "d")
    if s_types != d_types:
        raise ValueError("both sides need order columns of the same types")
    both = frames.running_by_group(s.unionByName(d), ["PRODUCT", "_side"], names, {"_seq": ("count", None), "_end": ("sum", "_q")})
    end = F.col("_end").cast("decimal(38,6)")
    item = F.struct(F.col("_seq").cast("bigint").alias("seq"), (end - F.col("_q")).cast("decimal(38,6)").alias("start"))
    # one row per cut point, so that equal ends are one
    cuts = both.where("_q > 0").groupBy("PRODUCT", end.alias("_end")).agg(
        F.min(F.when(F.col("_side") == "s", item)).alias("_s"), F.min(F.when(F.col("_side") == "d", item)).alias("_d"))
    run = frames.running_by_group(cuts, ["PRODUCT"], [F.col("_end").desc()], {"_supply": ("min", "_s"), "_demand": ("min", "_d")})
    # the last end before this one, of either side, is the start of one of both
    pegs = run.where("_supply is not null and _demand is not null").select(
        "PRODUCT", F.col("_demand.seq").alias("DEMAND_SEQ"), F.col("_supply.seq").alias("SUPPLY_SEQ"),
        (F.col("_end") - F.greatest("_supply.start", "_demand.start")).cast("decimal(38,6)").alias("PEG_QTY"))
    return pegs if exact else pegs.withColumn("PEG_QTY", F.col("PEG_QTY").cast("double"))


def mttf_mttr(down: DataFrame, eqp: str = "EQP_ID", start: str = "START_TS", end: str = "END_TS") -> DataFrame:
    """observed means per equipment: MTTR = mean down hours, MTTF = mean gap between down starts."""
    g = down.groupBy(eqp).agg(
        F.count(F.lit(1)).alias("N_DOWN"), F.avg(hours_between(F.col(start), F.col(end))).alias("MTTR_HOURS"),
        F.min(start).alias("_first"), F.max(start).alias("_last"))
    mttf = F.when(F.col("N_DOWN") > 1, hours_between(F.col("_first"), F.col("_last")) / (F.col("N_DOWN") - 1))
    return g.select(F.col(eqp).alias("EQP_ID"), "N_DOWN", "MTTR_HOURS", mttf.alias("MTTF_HOURS"))


def product_mix(df: DataFrame, day: str, product: str, qty: str) -> DataFrame:
    """each product's share of its day's total (aggregate, then join the day totals)."""
    per = df.groupBy(day, product).agg(F.sum(qty).alias("QTY"))
    tot = per.groupBy(day).agg(F.sum("QTY").alias("_day_total"))
    return per.join(tot, day).select(day, product, "QTY", F.try_divide(F.col("QTY"), F.col("_day_total")).alias("SHARE"))


def lot_merge(lots: DataFrame, key: str, lot: str = "LOT_ID", qty: str = "QTY") -> DataFrame:
    """children merged into the smallest lot id of their key, quantities summed."""
    return lots.groupBy(key).agg(F.min(lot).alias("PARENT_LOT"), F.count(F.lit(1)).alias("N_LOTS"),
                                 F.sum(qty).alias("TOTAL_QTY"))


def lot_children(lots: DataFrame, key: str, lot: str = "LOT_ID", chunk: int = 1000) -> DataFrame:
    """the child lots merged into each parent, in rows of at most ``chunk`` lots."""
    parent = lots.groupBy(key).agg(F.min(lot).alias("PARENT_LOT"))
    kids = lots.join(parent, key).where(F.col(lot) != F.col("PARENT_LOT"))
    c = frames.chunked_lists(kids, [key, "PARENT_LOT"], [lot], F.col(lot), chunk)
    return c.select(key, "PARENT_LOT", "CHUNK_NO", "N_ITEMS", F.array_join(F.transform(
        "ITEMS", lambda x: x.cast("string")), ",").alias("CHILDS"))


def call_profile(calls: DataFrame, methods: DataFrame, method: str = "METHOD", ms: str = "MS") -> DataFrame:
    """per method calls, total ms and mean ms (0 when there were no calls)."""
    agg = calls.groupBy(method).agg(F.count(F.lit(1)).alias("CALLS"), F.sum(ms).alias("TOTAL_MS"))
    j = methods.join(agg, method, "left")
    calls_c = F.coalesce(F.col("CALLS"), F.lit(0))
    total = F.coalesce(F.col("TOTAL_MS"), F.lit(0.0))
    return j.select(method, calls_c.alias("CALLS"), total.alias("TOTAL_MS"),
                    F.when(calls_c > 0, total / calls_c).otherwise(F.lit(0.0)).alias("MEAN_MS"))


def stamp(df: DataFrame, table_name: str, scenario: str, version: int, exclude: Sequence[str] = ()) -> DataFrame:
    """scenario / version columns on every output table not in the exclusion list."""
    if table_name.upper() in {t.upper() for t in exclude}:
        return df
    return df.select(F.lit(scenario).alias("SCENARIO_ID"), F.lit(version).alias("VERSION_NO"), "*")


def fab_in_out(events: DataFrame, part: str = "PART_ID", day: str = "DAY") -> DataFrame:
    """F7 by part: quantities in, out and scrapped, and the level at the end, per day, week of a month, month and in all.

    ``events`` has the part, the day (a timestamp) and decimal IN_QTY, OUT_QTY and SCRAP_QTY
    (null: nothing; scrap is part of what goes out).  WIP_QTY is the running sum of in less
    out of the part at the end of the period's last day with events; one running sum by day
    serves all levels.  GID tells the levels (``grouping_id`` of month, week, day).  A null
    part is a part; events without a day are left out.

    Added up by part and day first, a part has no more rows than the calendar has days, so
    windows of parts are bounded: one exchange by part serves the running sum and the sums
    of all levels, and a period's row leaves with the period's last day.
    """
    nothing = F.lit(0).cast("decimal(20,4)")
    amount = lambda c: F.sum(F.coalesce(F.col(c).cast("decimal(20,4)"), nothing)).alias(c)
    daily = events.where(F.col(day).isNotNull()).groupBy(F.col(part).alias("PART_ID"), F.date_trunc("day", F.col(day)).cast("timestamp_ntz").alias("DAY")).agg(
        amount("IN_QTY"), amount("OUT_QTY"), amount("SCRAP_QTY"))
    daily = daily.select("*", F.date_trunc("month", "DAY").cast("timestamp_ntz").alias("MONTH"),
                         F.date_trunc("week", "DAY").cast("timestamp_ntz").alias("WEEK")).repartition("PART_ID")
    # all in the order of part, month, week, day, so that the rows are sorted once
    spans = {7: Window.partitionBy("PART_ID").orderBy("MONTH", "WEEK", "DAY"),
             3: Window.partitionBy("PART_ID", "MONTH").orderBy("WEEK", "DAY"), 1: Window.partitionBy("PART_ID", "MONTH", "WEEK").orderBy("DAY")}
    sums = ("IN_QTY", "OUT_QTY", "SCRAP_QTY")
    running = [F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_{c}{gid}") for gid, w in spans.items() for c in sums]
    ends = [F.lead(F.lit(True)).over(w).isNull().alias(f"_end{gid}") for gid, w in spans.items()]
    level = daily.select("*", *running, *ends)
    none = F.lit(None).cast("timestamp_ntz")

    def row(gid, month, week, day, of):
        return F.struct(month.alias("MONTH"), week.alias("WEEK"), day.alias("DAY"), of[0].alias("FABIN_QTY"), of[1].alias("FABOUT_QTY"),
                        (F.col("_IN_QTY7") - F.col("_OUT_QTY7")).alias("WIP_QTY"), of[2].alias("SCRAP_QTY"), F.lit(gid).cast("bigint").alias("GID"))

    at = {0: ("MONTH", "WEEK", "DAY"), 1: ("MONTH", "WEEK"), 3: ("MONTH",), 7: ()}
    rows = [F.when(F.col(f"_end{gid}") if gid else F.lit(True), row(
        gid, *[F.col(c) if c in names else none for c in ("MONTH", "WEEK", "DAY")], [F.col(f"_{c}{gid}" if gid else c) for c in sums]))
        for gid, names in at.items()]
    return level.select("PART_ID", F.inline(F.array_compact(F.array(*rows))))
