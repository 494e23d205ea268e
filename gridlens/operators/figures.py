"""Figures: for each a claim, whether the data can show it, and a reason where they cannot.

A figure that is available has no reason, one that is not always has one. The
figures are one relation (figure, claim, available, reason, tier, stats); their series are another
(figure, series, x, y), so that a catalog of figures carries no points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators import bounded, forensics, segments, series, stats
from gridlens.session import stored

TIER = "Derived"
# Half windows of an event and of its peers, least points of a window.
EVENT_MS, PEER_MS, POINTS = 20 * 60_000, 15 * 60_000, 3


def figure(facts: DataFrame, name: str, claim: Column, ok: Column, why: Column | str, **told: Column) -> DataFrame:
    """One figure of one row of facts."""
    available = F.coalesce(ok, F.lit(False))
    reason = F.lit(why) if isinstance(why, str) else why
    return facts.select(F.lit(name).alias("figure"), claim.alias("claim"), available.alias("available"), F.when(~available, reason).alias("reason"), F.lit(TIER).alias("tier"), F.to_json(F.struct(*[c.alias(k) for k, c in told.items()])).alias("stats"))


def unavailable(facts: DataFrame, name: str, claim: str, why: str) -> DataFrame:
    """A figure that no data can show."""
    return figure(facts, name, F.lit(claim), F.lit(False), why)


def within(df: DataFrame, t: str, scope: tuple[int, int] | None) -> DataFrame:
    """Rows of the half-open range of a scope; all rows without one."""
    return df if scope is None else df.filter((F.col(t) >= scope[0]) & (F.col(t) < scope[1]))


def points(df: DataFrame, name: str, label: Column, x: str, y: str) -> DataFrame:
    return df.select(F.lit(name).alias("figure"), label.cast("string").alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def common_mode_at(bins: DataFrame, focus: DataFrame, anchor: DataFrame, radius_ms: int) -> DataFrame:
    """support, peers, mean_corr and mode of the peers around the anchor, each laid on the focus's grid by its nearest samples.

    `focus` has one row (entity), `anchor` at most one (t). Every other entity is a peer, however many there are;
    one without samples in the window, or rows without an entity, are none.
    """
    near = bins.filter(F.col("entity").isNotNull()).join(F.broadcast(anchor.select(F.col("t").alias("at__"))), F.col("bin_ms").between(F.col("at__") - radius_ms, F.col("at__") + radius_ms)).drop("at__")
    moved = stored(forensics.normalized(near, ["entity"], "bin_ms", "mean"), "moved")
    own = moved.join(F.broadcast(focus.select("entity")), "entity", "left_semi").select("bin_ms", F.col("y_norm").alias("fy"))
    others = moved.join(F.broadcast(focus.select("entity")), "entity", "left_anti")
    # the points of one entity's window are broadcast; the peers are dealt by entity
    grid = others.select("entity").distinct().crossJoin(F.broadcast(own.select("bin_ms")))
    laid = forensics.nearest(grid, others, ["entity"], "bin_ms", "y_norm").join(F.broadcast(own), "bin_ms")
    last = lambda c: F.sign(F.max_by(c, "bin_ms"))
    peers = laid.groupBy("entity").agg(stats.correlation("near_y", "fy").alias("corr"), ((F.count("*") >= 2) & (last("near_y") == last("fy"))).alias("same_sign"))
    return forensics.common_mode(peers)


def grid_figures(bins: DataFrame, samples: DataFrame, deviation: DataFrame | None = None, scope: tuple[int, int] | None = None, event_ms: int = EVENT_MS, peer_ms: int = PEER_MS, quality_ms: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(figures, points) of power series: bins (entity, bin_ms, n, lo, hi, mean), samples (entity, t, quality), deviation as bins or None.

    The focus is the entity with the widest range; it is compared with all others. Without any series all figures are there, unavailable.
    What several figures read is stored, as each would plan and count it anew, which takes the driver's memory.
    """
    bins = stored(bins, "bins")
    focus = stored(series.top_entities(bins, "entity", 1).select("entity", "range"), "focus")
    own = stored(bins.join(F.broadcast(focus.select("entity")), "entity", "left_semi"), "own")
    anchor = stored(forensics.step_anchor(within(own, "bin_ms", scope), ["entity"]), "anchor")
    name = stored(focus.agg(F.first("entity").alias("focus"), F.first("range").alias("range")), "name")
    facts = lambda df, **aggs: df.agg(*[c.alias(k) for k, c in aggs.items()]).crossJoin(F.broadcast(name))
    at = stored(anchor.agg(F.first("t").alias("anchor_ms"), F.first("step").alias("step")), "at")
    who = F.coalesce(F.col("focus").cast("string"), F.lit("No entity"))

    f1 = facts(own, n=F.count("*")).crossJoin(F.broadcast(at))
    out = [figure(f1, "A-F1", F.concat(who, F.lit(" leaves its normal range of output in places")), F.col("n") >= 2, F.when(F.col("n") == 0, "no series of power").otherwise("too few points"), entity=F.col("focus"), range=F.col("range"), event_ms=F.col("anchor_ms"), step=F.col("step"), scoped=F.lit(scope is not None))]

    zoom = forensics.normalized(forensics.around(own, anchor, ["entity"], "bin_ms", event_ms), ["entity"], "bin_ms", "mean")
    out.append(figure(facts(zoom, n=F.count("*")), "A-F2", F.lit("The change gathers in an event of minutes"), F.col("n") >= POINTS, "too few points around the event", entity=F.col("focus"), points=F.col("n")))

    steps = segments.previous(own, ["entity"], ["bin_ms"], F.lit(0), t0=F.col("bin_ms"), y0=F.col("mean")).filter(F.col("bin_ms") > F.col("t0"))
    rates = steps.select("entity", "bin_ms", (F.abs(F.col("mean") - F.col("y0")) / ((F.col("bin_ms") - F.col("t0")) / F.lit(3_600_000.0))).alias("rate"))
    quantiles = stats.lower_quantiles(rates, "rate", {"p50": 0.5, "p95": 0.95}, ["entity"])
    quantiles = stored(quantiles.agg(F.first("p50").alias("p50"), F.first("p95").alias("p95"), F.first("max").alias("max")), "quantiles")
    out.append(figure(facts(rates, n=F.count("*")).crossJoin(F.broadcast(quantiles)), "A-F3", F.lit("The output changes fast against its median"), F.col("n") >= 2, "no steps to take a rate of", p50=F.col("p50"), p95=F.col("p95"), max=F.col("max")))

    mode = stored(common_mode_at(bins, focus, anchor, peer_ms), "mode")
    windows = bins.join(F.broadcast(at), F.col("bin_ms").between(F.col("anchor_ms") - peer_ms, F.col("anchor_ms") + peer_ms))
    f4 = facts(windows, n=F.count_distinct("entity")).crossJoin(F.broadcast(mode))
    said = F.when(F.col("mode") == "common", "Other entities move along").when(F.col("mode") == "local", "The focus alone moves").otherwise("Whether others move along cannot be told from this log")
    known = F.col("mode") != "unknown"
    out.append(figure(f4, "A-F4", said, (known & (F.col("n") >= 2)) | (~known & (F.col("n") >= 1)), "no other entity to compare with", mode=F.col("mode"), support=F.col("support"), peers=F.col("peers"), mean_corr=F.col("mean_corr")))

    asked = anchor.select("entity", F.col("t").alias("asked_ms"))
    of_focus = samples.join(F.broadcast(asked.select("entity")), "entity", "left_semi")
    flagged = stored(bounded.flag_at(asked, of_focus, ["entity"], "asked_ms", "t", "quality", quality_ms).agg(F.first("quality").alias("quality")), "flagged")
    bad = F.coalesce(F.col("quality") != 1, F.lit(False))
    out.append(figure(facts(own, n=F.count("*")).crossJoin(F.broadcast(flagged)), "A-F5", F.when(bad, "Telemetry is of low quality at the event").otherwise("The output changes without a loss of quality"), F.col("n") > 0, "no series of power", quality=F.col("quality"), degraded=bad))

    if deviation is None:
        out.append(unavailable(facts(own, n=F.count("*")), "A-F6", "Where measured and scheduled power part", "no column of deviations"))
    else:
        dev = stored(deviation.join(F.broadcast(focus.select("entity")), "entity", "left_semi").filter("mean is not null"), "deviation")
        level = forensics.level_anchor(within(dev, "bin_ms", scope), ["entity"], "bin_ms", "mean").agg(F.first("t").alias("at_ms"), F.first("y").alias("deviation"))
        f6 = facts(dev, n=F.count("*"), least=F.min("mean"), most=F.max("mean")).crossJoin(F.broadcast(level))
        out.append(figure(f6, "A-F6", F.concat(who, F.lit(" parts most from its schedule at one time")), F.col("n") >= 2, "too few deviations", least=F.col("least"), most=F.col("most"), at_ms=F.col("at_ms"), deviation=F.col("deviation")))

    drawn = [points(own, "A-F1", F.col("entity"), "bin_ms", "mean"), points(zoom, "A-F2", F.col("entity"), "bin_ms", "y_norm"), points(rates, "A-F3", F.lit("rate"), "bin_ms", "rate"), points(windows, "A-F4", F.col("entity"), "bin_ms", "mean")]
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, drawn)


def resistance_points(events: DataFrame) -> DataFrame:
    """cell (from 1), t and r of events with an array of resistances; what is not finite is no point."""
    each = events.select("t", F.posexplode("r").alias("p", "r"))
    return each.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf"))).select((F.col("p") + 1).alias("cell"), "t", "r")


def battery_figures(events: DataFrame, spread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figures, points) of resistance events (t, i, soc, t_mean, r and bal by cell) and of the spread of voltages (t, v_range)."""
    matched = forensics.matched_point(events.withColumn("all__", F.lit(1)), ["all__"], {"soc": 15.0, "t_mean": 15.0, "i": 25.0})
    by_cell = resistance_points(matched)
    drifts = forensics.drift(by_cell, ["cell"], ["t", "r"], "r")
    # the highest signed drift, of equal ones the lowest cell; at most as many rows as cells
    worst = drifts.agg(F.max_by(F.struct("cell", "drift"), F.struct("drift", -F.col("cell"))).alias("w")).select("w.cell", "w.drift")
    n = events.agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).crossJoin(F.broadcast(by_cell.agg(F.count("*").alias("points")))).crossJoin(F.broadcast(matched.agg(F.count("*").alias("matched")))).crossJoin(F.broadcast(worst))
    who = F.coalesce(F.concat(F.lit("Cell "), F.col("cell").cast("string")), F.lit("No cell"))
    out = [
        figure(n, "B-F1", F.concat(who, F.lit(" parts from its peers in effective series resistance; the physical cause is not established")), F.col("points") > 0, "too few changes of current to tell a resistance", cell=F.col("cell"), drift=F.col("drift"), events=F.col("events"), matched=F.col("matched"), first_t=F.col("first_t"), last_t=F.col("last_t")),
        figure(n, "B-F2", F.lit("The resistances still part at like operating points"), F.col("points") > 0, "no event at a like operating point", matched=F.col("matched"), events=F.col("events")),
        figure(spread.filter("v_range is not null").agg(F.count("*").alias("n")), "B-F3", F.lit("The spread of the cells' voltages over time"), F.col("n") >= 2, "no series of the spread of voltages", points=F.col("n")),
    ]
    own = by_cell.join(F.broadcast(worst.select("cell")), "cell", "left_semi")
    daily = own.groupBy(F.lit(1).alias("all__"), F.floor(F.col("t") / series.DAY_MS).alias("day")).agg(F.percentile("r", F.lit(0.5)).alias("y"))
    spans = daily.groupBy("all__").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    knee = forensics.knee_agreement(forensics.piecewise_knee(daily, ["all__"], "day", "y"), forensics.chord_knee(daily, ["all__"], "day", "y"), spans, ["all__"]).agg(F.first("knee").alias("knee"), F.first("reason").alias("why"), F.count("*").alias("n"))
    out.append(figure(knee, "B-F4", F.when(F.col("knee").isNotNull(), "Two methods find the same knee of the resistance").otherwise("No knee of the resistance found by two methods"), F.col("knee").isNotNull(), F.coalesce(F.col("why"), F.lit("no series of a cell that parts")), knee_day=F.col("knee")))
    out.append(unavailable(n, "B-F5", "The probability of a fault rises at a cell before its peers", "no model of fault probability is part of this library"))
    burden = forensics.balancing_burden(events.withColumn("all__", F.lit(1)).filter("bal is not null"), ["all__"], "t", "bal")
    most = burden.agg(F.max_by(F.struct("cell", "charge"), F.struct("charge", -F.col("cell"))).alias("m")).select("m.cell", "m.charge")
    out.append(figure(most, "B-F6", F.concat(F.lit("Balancing weighs on cell "), F.coalesce(F.col("cell").cast("string"), F.lit("none"))), F.coalesce(F.col("charge"), F.lit(0.0)) > 0, "no balancing currents", cell=F.col("cell"), charge=F.col("charge")))
    label = F.concat(F.lit("Cell "), F.col("cell").cast("string"))
    drawn = [points(by_cell, "B-F1", label, "t", "r"), points(spread.filter("v_range is not null"), "B-F3", F.lit("v_range"), "t", "v_range"), points(own, "B-F4", label, "t", "r"), points(burden, "B-F6", F.lit("charge"), "cell", "charge")]
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, drawn)


def generic_figures(bins: DataFrame) -> DataFrame:
    """The one figure of other logs: the first entity's main series."""
    first = bins.groupBy("entity").agg(F.count("*").alias("n"), (F.max("hi") - F.min("lo")).alias("range"), F.min("bin_ms").alias("at")).agg(F.min_by(F.struct("entity", "n", "range"), F.struct("at", "entity")).alias("f")).select("f.*")
    return figure(first, "F1", F.concat(F.coalesce(F.col("entity").cast("string"), F.lit("No entity")), F.lit(" over the time observed")), F.col("n") > 0, "too few points of a series", entity=F.col("entity"), points=F.col("n"), range=F.col("range"))


def dispatched(dialects: DataFrame, by_dialect: dict[str, DataFrame]) -> DataFrame:
    """Figures of every dialect among the sources (dialect); a mix of dialects has the figures of each."""
    marked = [df.withColumn("dialect", F.lit(d)) for d, df in by_dialect.items()]
    return reduce(DataFrame.unionByName, marked).join(F.broadcast(dialects.select("dialect").distinct()), "dialect", "left_semi")


def spans_of(drawn: DataFrame, timed: list[str]) -> DataFrame:
    """figure, lo and hi of the figures whose x is a time."""
    return drawn.filter(F.col("figure").isin(timed)).groupBy("figure").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


LEDGER = ["evidence_id", "case_id", "at_time", "source", "signal", "observation", "derived", "supports", "contradicts", "confidence", "figure", "notes"]


def ledger(parts: list[DataFrame], order: list[str], most: int = 80, width: int = 400) -> DataFrame:
    """The twelve columns of a ledger, from parts that each tell some of them: parts in turn, each in `order`, E001 and so on.

    What a part does not tell is empty, its confidence Medium; `derived` is cut at `width`.
    """
    whole = []
    for i, part in enumerate(parts):
        kept = part.orderBy(*order).limit(most)
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in part.columns else F.lit("Medium" if c == "confidence" else "") for c in LEDGER[1:]]
        whole.append(kept.select(F.lit(i).alias("part__"), F.struct(*order).cast("string").alias("own__"), *[F.col(c).alias(f"order__{k}") for k, c in enumerate(order)], *[c.alias(n) for c, n in zip(cells, LEDGER[1:], strict=True)]))
    rows = reduce(lambda a, b: a.unionByName(b), whole)
    w = Window.orderBy("part__", *[f"order__{k}" for k in range(len(order))])  # at most `most` rows a part
    out = rows.withColumn("n__", F.row_number().over(w)).filter(F.col("n__") <= most)
    return out.select(F.format_string("E%03d", "n__").alias("evidence_id"), *[F.substring(c, 1, width).alias(c) if c == "derived" else F.col(c) for c in LEDGER[1:]])


def evidence_catalog(found: DataFrame) -> DataFrame:
    """What of a ledger goes with a draft."""
    return found.select("evidence_id", "figure", "observation", "supports", "contradicts", "confidence")
