"""Window functions over frames (W1-W9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks
from .blocks import BLOCK


def majority_events(occupancy: DataFrame, r: int, keys: list[str] = ["cell"], label: str = "lipid_nr", frame: str = "frame", dump: bool = True, block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Dwell intervals (keys, label, bind_i, bind_f, dwell) of a noise-filtered occupancy; negative labels are nothing.

    A label holds its cell at frame f when it fills at least half of the frames f - 2r .. f; nothing is emitted before frame 2r. Sweep
    line: a row adds one from f on and takes one away from f + 2r + 1 on, so that a running sum counts without copying rows; it runs block by block.
    dump False leaves out intervals that are open on the last frame.
    """
    span, series = 2 * r + 1, [*keys, label]
    occ = occupancy.filter(F.col(label) >= 0).select(*series, F.col(frame).alias("_f"))
    steps = occ.withColumn("_d", F.lit(1)).unionByName(occ.select(*series, (F.col("_f") + span).alias("_f"), F.lit(-1).alias("_d"))).groupBy(*series, "_f").agg(F.sum("_d").alias("_d"))
    last = occupancy.agg(F.max(frame).alias("_last"))
    rows = blocks.scan(steps, series, "_f", sums={"_n": F.col("_d")}, following="_nf", block=block).filter((2 * F.col("_n") >= span) & F.col("_nf").isNotNull())
    rows = rows.crossJoin(F.broadcast(last)).select(*series, F.greatest("_f", F.lit(2 * r)).alias("_a"), F.least(F.col("_nf") - 1, F.col("_last")).alias("_b"), "_last").filter("_a <= _b")
    out = blocks.runs(rows, series, "_a", "_b", block=block).groupBy(*series, "_run").agg(F.min("_a").cast("int").alias("bind_i"), F.max("_b").cast("int").alias("bind_f"), F.max("_last").alias("_last"))
    if not dump:
        out = out.filter("bind_f < _last")
    return out.select(*series, "bind_i", "bind_f", (F.col("bind_f") - F.col("bind_i") + 1).cast("int").alias("dwell"))


def islands(timeline: DataFrame, keys: list[str], last: int, frame: str = "frame", closed_end: bool = False, block: int = BLOCK) -> DataFrame:
    """Runs of frames (rows present) as intervals. Unless closed_end, a run open on the last frame ends one frame early and one that starts
    there is dropped. Runs are found block by block."""
    rows = blocks.runs(timeline.select(*keys, F.col(frame).alias("_f")).distinct(), keys, "_f", "_f", block=block)
    out = rows.groupBy(*keys, "_run").agg(F.min("_f").cast("int").alias("bind_i"), F.max("_f").cast("int").alias("bind_f")).drop("_run")
    if not closed_end:
        out = out.withColumn("bind_f", F.when(F.col("bind_f") == last, last - 1).otherwise(F.col("bind_f")).cast("int")).filter("bind_i <= bind_f")
    return out.withColumn("dwell", (F.col("bind_f") - F.col("bind_i") + 1).cast("int"))


def window_vote(timeline: DataFrame, keys: list[str], w: int, cutoff: float, count: str = "n") -> DataFrame:
    """Dense timeline (keys, frame, count) -> occupied 1 where more than half of the 2w + 1 centred frames have count >= cutoff; 0 at the edges."""
    win = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-w, w)
    votes = F.sum(F.when(F.col(count) >= cutoff, 1).otherwise(0)).over(win)
    full = F.count(F.lit(1)).over(win) == 2 * w + 1
    return timeline.withColumn("occupied", F.when(full & (2 * votes > 2 * w + 1), 1).otherwise(0))


def state_fold(df: DataFrame, key: str, state: str, levels: int = 5, block: int = BLOCK) -> DataFrame:
    """Ordered passages through states 0 .. levels - 1 of each entity: (key, direction, start, end, duration).

    Downward 0, 1, .., levels - 1, upward the reverse; start is the last frame in the first state before the passage. Each direction starts clean.
    A visit of the first state forgets all before it, and from there a step back or one level on keeps the passage alive, a skip ends it. So the
    automaton is a last visit, carried block by block, and for the rows after it their first frame in the last state, if no skip lies before that.
    Both directions are carried by one scan; rows are told apart by direction behind it.
    Null states, and those beyond the levels, are skips."""
    beyond = F.lit(levels + 1)
    at = {"down": F.coalesce(F.col(state), beyond), "up": F.coalesce(F.lit(levels - 1) - F.col(state), beyond)}
    rows = df.select(key, "frame", *[level.alias(f"_at_{d}") for d, level in at.items()])
    rows = blocks.scan(rows, [key], "frame", lasts={f"_start_{d}": F.when(F.col(f"_at_{d}") == 0, F.col("frame")) for d in at}, previous={f"_was_{d}": F.col(f"_at_{d}") for d in at}, block=block)
    turns = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), *[F.col(f"_{c}_{d}").alias(f"_{c}") for c in ("at", "was", "start")]) for d in at]))
    rows, series = rows.select(key, "frame", turns.alias("_t")).select(key, "frame", "_t.*"), [key, "direction"]
    there, skip = F.min(F.when(F.col("_at") == levels - 1, F.col("frame"))), F.min(F.when(F.col("_at") > F.col("_was") + 1, F.col("frame")))
    passed = rows.filter(F.col("_start").isNotNull()).groupBy(*series, "_start").agg(there.alias("_end"), skip.alias("_skip")).filter(F.col("_skip").isNull() & F.col("_end").isNotNull() | (F.col("_end") < F.col("_skip")))
    return passed.select(*series, F.col("_start").cast("int").alias("start"), F.col("_end").cast("int").alias("end"), (F.col("_end") - F.col("_start")).cast("int").alias("duration"))


def hysteresis(df: DataFrame, keys: list[str], ratio: str, high: float, low: float, block: int = BLOCK) -> DataFrame:
    """on turns 1 at ratio >= high, stays while ratio > low, else 0: the last row that decides either way counts, carried block by block."""
    decisive = F.when(F.col(ratio) >= high, 1).when(F.col(ratio) <= low, 0)
    return blocks.scan(df, keys, "frame", lasts={"on": decisive}, block=block).withColumn("on", F.coalesce("on", F.lit(0)))


def unwrap(df: DataFrame, axes: str, box: dict[str, float], key: str = "atom_nr", cutoff: float = 0.5, where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Undoes periodic jumps: a step beyond +-cutoff boxes adds one image against it, from that frame on; images add up block by block."""
    rows = blocks.jumps(df, [key], "frame", {f"_images_{a}": (a, cutoff * box[a]) for a in axes}, block)
    moved = {a: F.col(a) + F.col(f"_images_{a}") * box[a] for a in axes}
    return rows.withColumns({a: m if where is None else F.when(where, m).otherwise(F.col(a)) for a, m in moved.items()}).drop(*[f"_images_{a}" for a in axes])


def running_average(df: DataFrame, column: str, r: int, order: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """Centred mean over 2r + 1 rows; null in the first and last r rows of a series. keys: one series each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-r, r)
    return df.withColumn(f"{column}_avg", F.when(F.count(F.lit(1)).over(w) == 2 * r + 1, F.avg(column).over(w)))


def shell_vote(df: DataFrame, keys: list[str], r: int, shell: str = "shell", n: int = 6) -> DataFrame:
    """Most frequent shell (1..n) of the trailing r frames; ties go to the inner shell."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(r - 1), 0)
    counts = [F.sum(F.when(F.col(shell) == k, 1).otherwise(0)).over(w) for k in range(1, n + 1)]
    most = F.greatest(*counts)
    vote = F.coalesce(*[F.when(c == most, k) for k, c in enumerate(counts, 1)])
    return df.withColumn("voted", vote)


def jump_flags(df: DataFrame, box_z: float) -> DataFrame:
    """(frame, res_nr, jumped): 1 if any atom moved more than half the box in z since the frame before."""
    w = Window.partitionBy("atom_nr").orderBy("frame")
    step = F.abs(F.col("z") - F.lag("z").over(w))
    return df.withColumn("_s", F.when(step > box_z / 2, 1).otherwise(0)).groupBy("frame", "res_nr").agg(F.max("_s").alias("jumped"))
