"""Lattice algebra, masks and distance profiles (D1-D17), and what kinetics builds on them (K25-K27). A lattice is (gx, gy, value[, rho]) with null as
mask; extra key columns (by) keep many lattices apart."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import koff, stacked
from .lattice import Lattice
from .rangejoin import align, lookup
from .stats import histogram
from .transforms import checkpointed, components, discard
from .windows import hysteresis, islands, shell_vote, window_vote

XY = ["gx", "gy"]


def _envelope(heights: list[tuple[int, int]], at: list[int]) -> list[tuple[int, int]]:
    """For each place of at (ascending), (dx, dy) of the least dx * dx + dy * dy, over heights (y, dx) with ascending y and dy = place - y: the lower envelope of the
    parabolas, in one pass."""
    hull: list[tuple[int, int]] = []
    starts: list[float] = []
    for y, dx in heights:
        while hull:
            y0, d0 = hull[-1]
            cross = ((y * y + dx * dx) - (y0 * y0 + d0 * d0)) / (2 * (y - y0))
            if cross > starts[-1]:
                break
            hull.pop()
            starts.pop()
        starts.append(cross if hull else float("-inf"))
        hull.append((y, dx))
    out, k = [], 0
    for y in at:
        while k + 1 < len(hull) and starts[k + 1] <= y:
            k += 1
        out.append((hull[k][1], y - hull[k][0]))
    return out


def mask_distance(grid: DataFrame, mask: DataFrame, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gx, gy, dist): distance of every node to the nearest mask node of its lattice; lattices without a mask have no rows.

    A separable distance transform. Along each row (one gy), the nearest mask nodes before and after a node give its distance in x; along each
    column (one gx) the lower envelope of the rows' parabolas gives the nearest of all. No node meets all mask nodes, and lattices are kept apart by `by`."""
    keys = [*by, *XY]
    asked, marks = grid.select(*keys).distinct(), mask.select(*keys).distinct()
    low, high = asked.agg(F.min("gx"), F.max("gx")).first()
    along = F.sequence(F.lit(low or 0).cast("int"), F.lit(high or 0).cast("int"))
    line = marks.select(*by, "gy").distinct().withColumn("gx", F.explode(along)).select(*keys, F.lit(0).alias("_on")).unionByName(marks.withColumn("_on", F.lit(1)))
    row = Window.partitionBy(*by, "gy").orderBy("gx", F.desc("_on"))
    hit = F.when(F.col("_on") == 1, F.col("gx"))
    back = F.col("gx") - F.last(hit, True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(hit, True).over(row.rowsBetween(0, Window.unboundedFollowing)) - F.col("gx")
    heights = line.withColumn("_dx", F.least(back, ahead)).filter("_on = 0")
    node = lambda df, dx, ask: df.select(*by, F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), dx.cast("int").alias("_dx"), F.lit(ask).alias("_ask"))
    near = node(heights, F.col("_dx"), False).unionByName(node(asked, F.lit(None), True))
    names = [*by, "gx", "gy", "_dx", "_dy"]

    def column(table: pa.Table) -> pa.Table:
        table = table.sort_by("gy")
        gy, dx, ask = (table[c].to_pylist() for c in ("gy", "_dx", "_ask"))
        heights = [(y, d) for y, d in zip(gy, dx) if d is not None]
        asked = [k for k, a in enumerate(ask) if a] if heights else []
        found = _envelope(heights, [gy[k] for k in asked]) if asked else []
        part = table.take(pa.array(asked, pa.int64()))
        return pa.table([*(part[c] for c in (*by, "gx", "gy")), pa.array([d for d, _ in found], pa.int32()), pa.array([d for _, d in found], pa.int32())], names)

    schema = "".join(f"{c} {grid.schema[c].dataType.simpleString()}, " for c in by) + "gx int, gy int, _dx int, _dy int"
    found = near.groupBy(*by, "gx").applyInArrow(column, schema)
    x, y = F.col("_dx") * F.lit(cell), F.col("_dy") * F.lit(cell)
    return found.select(*by, *XY, F.sqrt(x * x + y * y).alias("dist"))


def distance_bands(dist: DataFrame, n: int, res: float, width: float, cumulative: bool = False) -> DataFrame:
    """(q, gx, gy): nodes with q * res - width < dist < q * res + width, both strict (cumulative: from 0), never dist 0."""
    q = dist.sparkSession.range(n).select(F.col("id").cast("int").alias("q"))
    low = F.lit(0.0) if cumulative else F.col("q") * res - width
    return dist.join(F.broadcast(q), (F.col("dist") != 0) & (F.col("dist") > low) & (F.col("dist") < F.col("q") * res + width)).select("q", *XY)


def distance_profile(data: DataFrame, bands: DataFrame) -> DataFrame:
    """(q, value, n): mean of unmasked data in each band."""
    return bands.join(data.filter("value is not null"), XY).groupBy("q").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def enrichment_profile(a: DataFrame, b: DataFrame, bands: DataFrame, bulk: float) -> DataFrame:
    """(q, value): ratio of the two densities' sums in a band against bulk, in percent; null where the second sum is 0."""
    j = align(a, b)
    s = bands.join(j, XY).groupBy("q").agg(F.sum("value").alias("a"), F.sum("value_2").alias("b"))
    return s.select("q", F.when(F.col("b") != 0, (F.col("a") / F.col("b") - bulk) / bulk * 100.0).alias("value"))


def integrate(data: DataFrame, where: Column | None = None, mask: DataFrame | None = None) -> DataFrame:
    """One row: mean, population standard deviation and count over the region, masked nodes skipped."""
    rows = data if where is None else data.filter(where)
    rows = rows.join(mask.select(*XY), XY, "left_semi") if mask is not None else rows
    return rows.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))


def edit(data: DataFrame, where: Column, value: float) -> DataFrame:
    return data.withColumn("value", F.when(where, F.lit(float(value))).otherwise(F.col("value")))


def add(data: DataFrame, c: float) -> DataFrame:
    return data.withColumn("value", F.col("value") + F.lit(float(c)))


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a; masked if either is."""
    return align(a.select(*XY, "value"), b.select(*XY, "value")).select(*XY, (F.col("value_2") - F.col("value")).alias("value"))


def midplane(a: DataFrame, b: DataFrame) -> DataFrame:
    return align(a.select(*XY, "value"), b.select(*XY, "value")).select(*XY, ((F.col("value") + F.col("value_2")) * 0.5).alias("value"))


def _nodes(grid: Lattice) -> float:
    return float(grid.n[0] * grid.n[1])


def leaflet_average(a: DataFrame, b: DataFrame, grid: Lattice, cutoff: float) -> DataFrame:
    """rho-weighted mean of two lattices, masked where rho1 + rho2 <= cutoff * its mean over all nodes."""
    j = align(a, b)
    r1, r2 = F.coalesce("rho", F.lit(0)), F.coalesce("rho_2", F.lit(0))
    v = (F.when(r1 > 0, F.col("value") * r1).otherwise(0.0) + F.when(r2 > 0, F.col("value_2") * r2).otherwise(0.0)) / (r1 + r2)
    rows = j.select(*XY, v.alias("value"), (r1 + r2).alias("rho"))
    mean = rows.agg((F.sum("rho") / _nodes(grid)).alias("_m"))
    return rows.crossJoin(F.broadcast(mean)).select(*XY, F.when(F.col("rho") > cutoff * F.col("_m"), F.col("value")).alias("value"), "rho")


def exclude_by(data: DataFrame, rho: DataFrame, grid: Lattice, cutoff: float) -> DataFrame:
    """Masks data where another table's rho <= cutoff * mean; masks that were there stay."""
    mean = rho.agg((F.sum("rho") / _nodes(grid)).alias("_m"))
    j = data.select(*XY, "value").join(rho.select(*XY, "rho"), XY, "left").crossJoin(F.broadcast(mean))
    return j.select(*XY, F.when(F.coalesce("rho", F.lit(0)) > cutoff * F.col("_m"), F.col("value")).alias("value"))


def protein_mask(rho: DataFrame, grid: Lattice, cutoff: float) -> DataFrame:
    """(gx, gy, mask): 1 where rho <= cutoff * mean(rho), empty nodes included."""
    mean = rho.agg((F.sum("rho") / _nodes(grid)).alias("_m"))
    full = grid.nodes(rho.sparkSession).join(rho.select(*XY, "rho"), XY, "left").crossJoin(F.broadcast(mean))
    return full.select(*XY, F.when(F.coalesce("rho", F.lit(0)) <= cutoff * F.col("_m"), 1).otherwise(0).alias("mask"))


#: Nodes a side of a block in which regions are found at once.
SIDE = 256


def _block_regions(names: list[str]):
    """Numbers the 8-connected regions of one block's nodes, by union and find along its rows."""
    def run(table: pa.Table) -> pa.Table:
        nodes = list(zip(table["gx"].to_pylist(), table["gy"].to_pylist()))
        number = {n: k for k, n in enumerate(nodes)}
        parent = list(range(len(nodes)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for k, (x, y) in enumerate(nodes):
            for near in ((x - 1, y - 1), (x - 1, y), (x - 1, y + 1), (x, y - 1)):
                if near in number:
                    one, two = find(k), find(number[near])
                    parent[max(one, two)] = min(one, two)
        return table.append_column("_region", pa.array([find(k) for k in range(len(nodes))], pa.int32())).select(names)

    return run


def regions(cells: DataFrame, by: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """(by, gx, gy, region): the 8-connected regions of nodes, for many lattices at once; a region's name is that of one of its parts.

    On two levels: regions inside blocks of nodes, each block on its own; then the graph of regions that touch across block borders, whose labels spread and
    jump. So rounds grow with the logarithm of the blocks that a region passes, not with the lattice's side."""
    keys = [*by, *XY]
    block = [F.floor(F.col(k) / F.lit(side)).cast("int").alias(f"_b{k}") for k in XY]
    nodes = cells.select(*keys).distinct().select(*by, *[F.col(k).cast("int").alias(k) for k in XY], *block)
    names = [*nodes.columns, "_region"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", _region int"
    inside = nodes.groupBy(*by, "_bgx", "_bgy").applyInArrow(_block_regions(names), schema)
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in (*by, "_bgx", "_bgy", "_region")])
    inside = checkpointed(inside.select(*keys, "_bgx", "_bgy", name.alias("_name")))
    on_edge = [F.pmod(F.col(k), F.lit(side)).isin(0, side - 1) for k in XY]
    edge = inside.filter(on_edge[0] | on_edge[1])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)])
    far = edge.select(*by, "gx", "gy", F.col("_bgx").alias("_ox"), F.col("_bgy").alias("_oy"), F.col("_name").alias("_from"), F.explode(around).alias("_s"))
    far = far.select(*by, (F.col("gx") + F.col("_s.i")).alias("gx"), (F.col("gy") + F.col("_s.j")).alias("gy"), "_ox", "_oy", "_from")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if k in by else F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    links = checkpointed(far.alias("l").join(edge.alias("r"), same).filter((F.col("_ox") != F.col("_bgx")) | (F.col("_oy") != F.col("_bgy"))).select(F.col("_from").alias("a"), F.col("_name").alias("b")).distinct())
    if not links.limit(1).count():
        return inside.select(*keys, F.col("_name").alias("region"))
    labels = components(links).select(F.col("atom_nr").alias("_name"), F.col("molecule").alias("_label"))
    discard(links)
    return inside.join(labels, "_name", "left").select(*keys, F.coalesce("_label", "_name").alias("region"))


def grow(cells: DataFrame, seeds: DataFrame, by: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """Nodes of cells that an 8-connected walk reaches from seeds, for many lattices at once: the regions that hold a seed."""
    keys = [*by, *XY]
    found = checkpointed(regions(cells, by, side))
    hit = found.join(seeds.select(*keys).distinct(), keys, "left_semi").select("region").distinct()
    return found.join(hit, "region", "left_semi").select(*keys)


def nan_region(data: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The connected region of masked nodes that holds the seeds."""
    return grow(data.filter("value is null"), seeds, by)


def free_energy_map(thickness: DataFrame, density: DataFrame, steps: DataFrame) -> DataFrame:
    """Free energy of each node's thickness by the lookup table (thickness, fe), and times its lipid density."""
    found = lookup(thickness.filter("value is not null").select(*XY, "value"), steps, "value", "thickness", 9)
    return found.join(density.select(*XY, F.col("value").alias("density")), XY).select(*XY, "fe", (F.col("fe") * F.col("density")).alias("value"))


def frame_distribution(frame_values: DataFrame, mask: DataFrame, width: float) -> DataFrame:
    """Histogram of per-frame node values inside a mask; means on an edge (to 9 digits) belong to the bin above it."""
    return histogram(frame_values.join(mask.select(*XY), XY, "left_semi"), "value", width, digits=9)


def frame_errors(frame_values: DataFrame, mean: DataFrame, mask: DataFrame) -> DataFrame:
    """(frame, error): RMS difference from the mean lattice inside a mask."""
    j = frame_values.join(mask.select(*XY), XY, "left_semi").join(mean.select(*XY, F.col("value").alias("_m")), XY)
    d = F.col("value") - F.col("_m")
    return j.groupBy("frame").agg(F.sqrt(F.avg(d * d)).alias("error"))


def closest_frame(frame_values: DataFrame, mean: DataFrame, mask: DataFrame) -> DataFrame:
    return frame_errors(frame_values, mean, mask).orderBy("error", "frame").limit(1)


def grid_stats(data: DataFrame, *by: str) -> DataFrame:
    return data.groupBy(*by).agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.count("value").alias("n"))


def residence_by_distance_window(ev: DataFrame, bands: DataFrame, n_frames: int, w: int, cutoff: float, dt: float) -> DataFrame:
    """Per band: events of lipids that hold at least cutoff of its nodes in most frames of a centred window, their mean dwell and off rate."""
    held = bands.join(ev, XY)
    counts = held.select("q", "lipid_nr", F.explode(F.sequence("bind_i", "bind_f")).alias("frame")).groupBy("q", "lipid_nr", "frame").agg(F.count("*").alias("n"))
    frames = ev.sparkSession.range(n_frames).select(F.col("id").cast("int").alias("frame"))
    dense = counts.select("q", "lipid_nr").distinct().crossJoin(F.broadcast(frames)).join(counts, ["q", "lipid_nr", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    on = window_vote(dense, ["q", "lipid_nr"], w, cutoff).filter("occupied = 1")
    return _band_rates(islands(on, ["q", "lipid_nr"], n_frames - 1), dt)


def _band_rates(runs: DataFrame, dt: float) -> DataFrame:
    base = runs.groupBy("q").agg(F.count("*").alias("n"), F.avg("dwell").alias("mean"))
    return base.join(koff(runs, dt, ("q",)), "q", "left")


def residence_by_distance_share(ev: DataFrame, bands: DataFrame, n_frames: int, high: float, low: float, dt: float) -> DataFrame:
    """As the window form, by the share of a lipid's nodes that lies in the band, with hysteresis: in at >= high, out at <= low or when unbound."""
    total = stacked(ev).select("frame", "lipid_nr", F.col("n").alias("all"))
    held = bands.join(ev, XY).select("q", "lipid_nr", F.explode(F.sequence("bind_i", "bind_f")).alias("frame")).groupBy("q", "lipid_nr", "frame").agg(F.count("*").alias("n"))
    frames = ev.sparkSession.range(n_frames).select(F.col("id").cast("int").alias("frame"))
    dense = held.select("q", "lipid_nr").distinct().crossJoin(F.broadcast(frames)).join(held, ["q", "lipid_nr", "frame"], "left").join(total, ["lipid_nr", "frame"], "left")
    dense = dense.withColumn("ratio", F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)))
    on = hysteresis(dense, ["q", "lipid_nr"], "ratio", high, low).filter("on = 1")
    return _band_rates(islands(on, ["q", "lipid_nr"], n_frames - 1), dt)


def solvation_shells(labels: DataFrame, mask: DataFrame, cutoffs: tuple[float, ...], cell: float) -> DataFrame:
    """(frame, label, shell): labels with a node within cutoff 1 of the mask are shell 1; those within cutoff n of shell n - 1 are shell n; the rest is the last + 1.

    Neighbourhoods are joined by node offsets within the cutoff, so that a round touches only nodes near the shell before. A round per shell."""
    n = len(cutoffs)
    near = mask.select(*XY)
    frames = labels.select("frame").distinct()
    border = frames.crossJoin(F.broadcast(near))
    done = None
    for k, cutoff in enumerate(cutoffs, 1):
        reach = int(cutoff / cell) + 1
        offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if ((i * cell) ** 2 + (j * cell) ** 2) ** 0.5 <= cutoff]
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
        around = border.withColumn("_s", F.explode(steps)).select("frame", (F.col("gx") + F.col("_s.i")).alias("gx"), (F.col("gy") + F.col("_s.j")).alias("gy")).distinct()
        hit = labels.join(around, ["frame", *XY]).select("frame", "label").distinct()
        fresh = hit.join(done.select("frame", "label"), ["frame", "label"], "left_anti") if done is not None else hit
        fresh = checkpointed(fresh.withColumn("shell", F.lit(k)))
        done = fresh if done is None else done.unionByName(fresh)
        border = labels.join(fresh.select("frame", "label"), ["frame", "label"]).select("frame", *XY)
    every = labels.select("frame", "label").distinct()
    return every.join(done, ["frame", "label"], "left").withColumn("shell", F.coalesce("shell", F.lit(n + 1)))


def shell_events(shells: DataFrame, r: int, last: int, n: int = 6) -> DataFrame:
    """Dwell intervals of labels in their voted shell."""
    return islands(shell_vote(shells, ["label"], r, n=n), ["label", "voted"], last)
