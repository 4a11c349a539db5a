"""Binding events: merging, screening, timelines, statistics, rates, exchange (K1-K24). Every operator keeps its key columns (a cell, a run) apart,
so that one job treats thousands of lattices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import scan
from .lattice import Lattice
from .rangejoin import nearest_event
from .stats import histogram
from .tessellate import tessellate
from .windows import islands, majority_events

CELL = ("gx", "gy")
LIPID = ("lipid_nr", "res_nr", "res_name")


def kinetics2d(sites: DataFrame, grid: Lattice, radius: float, r: int, box: tuple[float, float] | None = None) -> DataFrame:
    """Residence events per node: tessellate each frame, then filter and join runs over all frames."""
    labels = tessellate(sites, grid, radius, box)
    return majority_events(labels, r, keys=["gx", "gy"], label="res_nr")


def mend_events(ev: DataFrame, gap: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per (cell, lipid): contained events go; an event that starts within (end, end + gap] is joined; a partial overlap is a break. dwell = bind_f + 1 - bind_i."""
    part = [*keys, "lipid_nr"]
    w = Window.partitionBy(*part).orderBy("bind_i", F.desc("bind_f"))
    before = F.max("bind_f").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = ev.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("bind_f") > F.col("_before"))).drop("_before")
    last = F.lag("bind_f").over(w)
    joins = (F.col("bind_i") > last) & (F.col("bind_i") <= last + gap)
    runs = kept.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*part, "res_nr", "res_name", "_run").agg(F.min("bind_i").alias("bind_i"), F.max("bind_f").alias("bind_f")).drop("_run")
    return out.withColumn("dwell", (F.col("bind_f") + 1 - F.col("bind_i")).cast("int"))


def timeline(ev: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """One row per (cell, lipid, frame) bound."""
    return ev.select(*keys, *LIPID, F.explode(F.sequence("bind_i", "bind_f")).alias("frame")).distinct()


def stacked(ev: DataFrame) -> DataFrame:
    """(frame, lipid, n): cells that a lipid holds in a frame."""
    return timeline(ev).groupBy("frame", *LIPID).agg(F.count("*").cast("int").alias("n"))


def fill_gaps(ev: DataFrame, gap: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Pauses shorter than gap frames after a leave count as bound; lipids are kept apart."""
    return mend_events(ev, gap, keys)


def screen(ev: DataFrame, dt: float, cutoff: float) -> DataFrame:
    return ev.filter(F.col("dwell") * dt >= cutoff)


def block(ev: DataFrame, b: int, e: int) -> DataFrame:
    """Events that overlap frames b..e, clipped to them; dwell stays."""
    return ev.filter((F.col("bind_f") >= b) & (F.col("bind_i") <= e)).withColumns({"bind_i": F.greatest("bind_i", F.lit(b)), "bind_f": F.least("bind_f", F.lit(e))})


def sweep(tl: DataFrame, n: int) -> DataFrame:
    """Lipids whose count reaches the n-th largest of their frame; ties kept."""
    w = Window.partitionBy("frame").orderBy(F.desc("n"), "lipid_nr")
    ranked = tl.withColumn("_k", F.row_number().over(w))
    least = F.coalesce(F.max(F.when(F.col("_k") == n, F.col("n"))).over(Window.partitionBy("frame")), F.lit(0))
    return ranked.withColumn("_least", least).filter("n >= _least").drop("_k", "_least")


def renumber(ev: DataFrame) -> DataFrame:
    """lipid_nr = 0, 1, .. in residue order. The roster is numbered, then joined."""
    ids = ev.select("res_nr").distinct().select("res_nr", (F.dense_rank().over(Window.orderBy("res_nr")) - 1).cast("int").alias("_id"))
    return ev.join(ids, "res_nr").withColumn("lipid_nr", F.col("_id")).drop("_id")


def order_events(ev: DataFrame, mode: str) -> DataFrame:
    """mode: bind_i, bind_f, dwell (descending), repeats (descending, with column repeats) or res_nr (descending)."""
    if mode == "repeats":
        n = ev.groupBy(*[c for c in CELL if c in ev.columns], "res_nr").agg((F.count("*") - 1).alias("repeats"))
        ev = ev.join(n, [*[c for c in CELL if c in ev.columns], "res_nr"])
    first = F.col(mode) if mode.startswith("bind") else F.desc(mode)
    return ev.orderBy(first, "res_nr", "bind_i")


def repeat_visits(ev: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per cell and lipid: repeats (visits after the first), mean dwell, mean off time (bind_i - the last bind_f); single visits have off time 0."""
    w = Window.partitionBy(*keys, "res_nr").orderBy("bind_i", "bind_f")
    rows = ev.withColumn("_off", F.col("bind_i") - F.lag("bind_f").over(w))
    return rows.groupBy(*keys, "lipid_nr", "res_nr", "res_name").agg((F.count("*") - 1).cast("int").alias("repeats"), F.avg("dwell").alias("mean_dwell"), F.coalesce(F.avg("_off"), F.lit(0.0)).alias("mean_off"))


def koff(ev: DataFrame, dt: float, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Off rate per key: survival at each observed dwell, least squares of ln S on time; koff = -slope, r2. Null for fewer than two dwells."""
    n = ev.groupBy(*keys, "dwell").agg(F.count("*").alias("n"))
    longest = Window.partitionBy(*keys).orderBy(F.desc("dwell")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*keys))
    s = n.select(*keys, (F.col("dwell") * F.lit(dt)).alias("t"), F.log(F.sum("n").over(longest) / total).alias("y"))
    return s.groupBy(*keys).agg(F.when(F.count("*") > 1, -F.regr_slope("y", "t")).alias("koff"), F.when(F.count("*") > 1, F.regr_r2("y", "t")).alias("r2"))


def event_stats(ev: DataFrame, dt: float, cutoff: float = 0.0, gap: int | None = None, types: tuple[str, ...] | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per key: count, mean dwell, sd (n - 1), largest dwell (frames), koff, r2, after merging, screening and choosing lipid types."""
    ev = mend_events(ev, gap, keys) if gap is not None else ev
    ev = screen(ev, dt, cutoff)
    ev = ev.filter(F.col("res_name").isin(*types)) if types else ev
    base = ev.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dwell").alias("mean"), F.stddev_samp("dwell").alias("sd"), F.max("dwell").alias("largest"))
    return base.join(koff(ev, dt, keys), list(keys), "left") if keys else base.crossJoin(koff(ev, dt, keys))


def event_stats_single(ev: DataFrame, b: int, e: int, dt: float, width: float, gap: int) -> tuple[DataFrame, DataFrame]:
    """One set of events as a whole: statistics, and the histogram of dwells."""
    one = mend_events(block(ev, b, e), gap)
    return event_stats(one, dt, keys=()), histogram(one, "dwell", width)


def list_events(ev: DataFrame, gap: int, dt: float, cutoff: float, mode: str = "bind_i") -> DataFrame:
    out = screen(mend_events(ev, gap), dt, cutoff)
    return order_events(out.withColumns({"t_i": F.col("bind_i") * dt, "t_f": F.col("bind_f") * dt, "t_dwell": F.col("dwell") * dt}), mode)


def extract(ev: DataFrame, last: int, cutoff: int = 0, gap: int = 0, drop: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Drops short events, fills gaps, removes lipids on drop(res_nr) and frames in spans(lipid_nr, b, e), and joins what is left to events."""
    out = fill_gaps(ev.filter(F.col("dwell") >= cutoff), gap)
    out = out.join(drop.select("res_nr"), "res_nr", "left_anti") if drop is not None else out
    tl = timeline(out)
    if spans is not None:
        tl = tl.join(spans.withColumnRenamed("lipid_nr", "_l"), (F.col("lipid_nr") == F.col("_l")) & F.col("frame").between(F.col("b"), F.col("e")), "left_anti")
    return islands(tl, [*CELL, *LIPID], last)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Appends b, its lipid numbers moved past those of a."""
    offset = a.agg((F.coalesce(F.max("lipid_nr"), F.lit(-1)) + 1).alias("_o"))
    moved = b.crossJoin(F.broadcast(offset)).withColumn("lipid_nr", (F.col("lipid_nr") + F.col("_o")).cast("int")).drop("_o")
    return a.unionByName(moved.select(*a.columns))


def held(ev: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """(keys, start, end): the frames in which any event of a key is open, as intervals that don't overlap. An event is its two ends; the number of
    open ones is their running sum, block by block; no frame in between gets a row."""
    ends = ev.select(*keys, F.explode(F.array(F.struct(F.col("bind_i").alias("t"), F.lit(1).alias("s")), F.struct((F.col("bind_f") + 1).alias("t"), F.lit(-1).alias("s")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.t").alias("start")).agg(F.sum("e.s").alias("s"))
    return scan(steps, list(keys), "start", sums={"n": F.col("s")}, following="next").filter("n > 0").select(*keys, "start", (F.col("next") - 1).alias("end"))


def occupancy(ev: DataFrame, n_frames: int) -> DataFrame:
    """Share of frames in which a cell is held by any lipid."""
    return held(ev).groupBy(*CELL).agg((F.sum(F.col("end") - F.col("start") + 1) / F.lit(float(n_frames))).alias("value"))


def contributors(ev: DataFrame) -> DataFrame:
    """Means of repeats and off time over the lipids of a cell; single visits count with 0."""
    return repeat_visits(ev).groupBy(*CELL).agg(F.avg("repeats").alias("repeats"), F.avg("mean_off").alias("off_time"), F.count("*").alias("lipids"))


def bound_counts(ev: DataFrame, n_frames: int) -> DataFrame:
    """(frame, n): different lipids bound in each frame, 0 included. A lipid's intervals in all cells are united first; then their ends are summed
    along the frames."""
    spans = held(ev, ("lipid_nr",))
    steps = spans.select(F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("s")), F.struct((F.col("end") + 1).alias("t"), F.lit(-1).alias("s")))).alias("e")).groupBy(F.greatest(F.lit(0), "e.t").cast("int").alias("frame")).agg(F.sum("e.s").alias("s"))
    frames = ev.sparkSession.range(n_frames).select(F.col("id").cast("int").alias("frame")).join(steps, "frame", "left")
    return scan(frames, [], "frame", sums={"n": F.coalesce("s", F.lit(0))}).select("frame", "n")


def binding_timeline(ev: DataFrame, n_frames: int) -> DataFrame:
    """One row: percent of frames with any bound lipid, and the mean number over those frames."""
    n = bound_counts(ev, n_frames)
    on = F.when(F.col("n") > 0, F.col("n"))
    return n.agg((F.count(on) * 100.0 / F.lit(n_frames)).alias("percent"), F.avg(on).alias("mean_bound"))


def frames_from_events(ev: DataFrame, highlight: DataFrame | None = None) -> DataFrame:
    """(frame, cell, label): the least lipid bound; highlighted lipids as -(lipid + 1)."""
    out = timeline(ev).groupBy("frame", *CELL).agg(F.min("lipid_nr").alias("lipid_nr"))
    if highlight is None:
        return out.withColumnRenamed("lipid_nr", "label")
    h = highlight.select("lipid_nr").distinct().withColumn("_h", F.lit(1))
    return out.join(h, "lipid_nr", "left").select("frame", *CELL, F.when(F.col("_h") == 1, -(F.col("lipid_nr") + 1)).otherwise(F.col("lipid_nr")).alias("label"))


def percent_visited(ev: DataFrame, n_lipids: int, n_frames: int, freq: int, cutoff: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per key and every freq frames: percent of lipids that have begun a visit of at least cutoff frames by then."""
    first = ev.filter(F.col("dwell") >= cutoff).groupBy(*keys, "lipid_nr").agg(F.min("bind_i").alias("t"))
    steps = first.groupBy(*keys, F.ceil(F.col("t") / freq).cast("int").alias("k")).agg(F.count("*").alias("n"))
    marks = ev.sparkSession.range((n_frames + freq - 1) // freq).select(F.col("id").cast("int").alias("k"))
    full = ev.select(*keys).distinct().crossJoin(F.broadcast(marks)) if keys else marks
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = full.join(steps, [*keys, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, (F.col("k") * freq).alias("frame"), (F.sum("n").over(w) * 100.0 / F.lit(n_lipids)).alias("percent"))


def exchange(ev: DataFrame, leaving: Column, incoming: Column, bulk: float, allow_self: bool = False) -> DataFrame:
    """One row: events that leave and find a successor, the share replaced by chosen types less the bulk share, and its standard error over
    all events (those of other types count 0)."""
    n = nearest_event(ev)
    same = (F.col("next_lipid") == F.col("lipid_nr")) & (F.col("next_bind_i") == F.col("bind_i"))
    hit = F.when(leaving & ((~same) | F.lit(allow_self)), 1)
    coded = F.coalesce(F.when((hit == 1) & incoming, 1.0), F.lit(0.0))
    return n.agg(F.count(hit).alias("n"), (F.sum(coded) / F.count(hit) - bulk).alias("value"), (F.stddev_samp(coded) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("error"))


def exchange_delays(ev: DataFrame) -> DataFrame:
    """(delay, n): frames from a leave to the nearest start, self hits left out."""
    n = nearest_event(ev).filter("not (next_lipid = lipid_nr and next_bind_i = bind_i)")
    return n.groupBy((F.col("next_bind_i") - F.col("bind_f")).alias("delay")).agg(F.count("*").alias("n"))


def exchange_distances(ev: DataFrame, cell: float) -> DataFrame:
    """Per exchange: distance of the two lipids' label centroids, the leaving one at its last, the new one at its first frame."""
    labels = frames_from_events(ev)
    centroid = labels.groupBy("frame", F.col("label").alias("lipid_nr")).agg(F.avg("gx").alias("x"), F.avg("gy").alias("y"))
    n = nearest_event(ev).filter("not (next_lipid = lipid_nr and next_bind_i = bind_i)")
    a = centroid.select(F.col("frame").alias("bind_f"), "lipid_nr", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = centroid.select(F.col("frame").alias("next_bind_i"), F.col("lipid_nr").alias("next_lipid"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return n.join(a, ["bind_f", "lipid_nr"]).join(b, ["next_bind_i", "next_lipid"]).withColumn("distance", F.sqrt(dx * dx + dy * dy) * cell)


def complete_set(ev: DataFrame) -> DataFrame:
    """Roster of the lipids that have events."""
    return ev.select(*LIPID).distinct()
