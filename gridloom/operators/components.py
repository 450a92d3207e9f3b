"""Connected components in two levels, hole filling, distance and thinning.

Runs are cut at the borders of 256 x 256 blocks and labelled inside each block by union-find in one Arrow pass. Only pieces on borders are linked across, and only
those links form the global graph, which is contracted by alternating large-star and small-star steps over written edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import group_ordinal
from ..plans.scratch import StepTable, cut
from .blocks import BLOCK, ROW, border_links, cleaned_blocks, labelled, local_roots, row_distances, thinning_step
from .focal import run_cells, runs
from .tiling import TILE


def _rid():
    return F.col("y").cast("bigint") * F.lit(ROW) + F.col("x0").cast("bigint")


#: Neighbours of one node that one task handles in a contraction step; a node with more is split into as many parts as its measured degree needs.
HUB = 200_000
#: An edge table of up to so many rows is finished in one task.
FINISH = 1_000_000
_NEAR = 4096
_CHUNK = 200_000


def _stars(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Connected parts of a set of edges, each node linked to the smallest one."""
    ends = pd.concat([pdf[[*keys, c]].rename(columns={c: "u"}) for c in ("u", "v")], ignore_index=True)
    code = ends.groupby([*keys, "u"], sort=True, dropna=False).ngroup().to_numpy()
    nodes = ends.assign(code=code).drop_duplicates("code").sort_values("code")
    root = local_roots(len(nodes), code[: len(pdf)], code[len(pdf):])
    v = nodes["u"].to_numpy()[root]
    return nodes.drop(columns="code").assign(v=v)[root != np.arange(len(nodes))]


def _stars_of(edges: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """Replace edges by stars inside chunks of about `most` rows of each task (all rows of a task if not given)."""
    types = dict(edges.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if most and size >= most:
                yield _stars(pd.concat(held, ignore_index=True), keys)
                held, size = [], 0
        if size:
            yield _stars(pd.concat(held, ignore_index=True), keys)

    return edges.select(*keys, "u", "v").mapInPandas(run, schema)


def _contract_nearby(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Replace edges by stars inside bounded chunks of nearby ones; any subset of edges may be contracted on its own, so the result does not depend on the chunks."""
    row, col = F.expr(f"u div {ROW} div {_NEAR}"), F.expr(f"(u & {ROW - 1}) div {_NEAR}")
    near = [*keys, "_by", "_bx"]
    return _stars_of(edges.withColumn("_by", row).withColumn("_bx", col).repartition(*near).sortWithinPartitions(*near), keys, _CHUNK)


def _told(pairs: DataFrame, keys: list[str], hubs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs with `_m`, the smallest v of their u, and the table (u, _m).

    Minima are aggregated before the shuffle. Sending them back would bring all neighbours of a hub to one task, so those of nodes in `hubs` (u, parts) are dealt by a hash of v too.
    """
    low = pairs.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
    if hubs is None:
        return pairs.join(low, [*keys, "u"]), low
    # at most edges / HUB rows
    hubs = F.broadcast(hubs)
    part = F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = pairs.join(hubs, [*keys, "u"], "left").withColumn("_z", part).drop("_parts")
    answer = low.join(hubs, [*keys, "u"], "left").withColumn("_z", F.explode(F.sequence(F.lit(0), (F.coalesce("_parts", F.lit(1)) - 1).cast("int")))).drop("_parts")
    return salted.join(answer, [*keys, "u", "_z"]).drop("_z"), low


def _state(edges: DataFrame, keys: list[str], hub: int) -> tuple[int, bool, DataFrame | None]:
    """Number of edges, whether they are stars already (no node has two parents or is both), and the hubs; one aggregation over the nodes."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("u"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("_e")).select(*keys, "_e.*")
    nodes = ends.groupBy(*keys, "u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    size, bad, most = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int")), F.lit(0)), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0))).first()
    hubs = cut(nodes.filter(F.col("up") + F.col("down") > hub).select(*keys, "u", F.ceil((F.col("up") + F.col("down")) / hub).cast("int").alias("_parts")), "hubs") if most > hub else None
    return size, not bad, hubs


def contract(edges: DataFrame, keys: list[str] = TILE, finish: int = FINISH, hub: int = HUB) -> DataFrame:
    """Smallest reachable node of every node that has an edge: rows (keys, node, root)."""
    directed = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    step = StepTable(_contract_nearby(directed, keys), "edges")
    while True:
        e = step.df
        size, stars, hubs = _state(e, keys, hub)
        if stars:
            break
        if size <= finish:
            following = StepTable(_stars_of(e.repartition(1), keys, None), "edges")
        else:
            # large star: link every larger neighbour to the smallest neighbour
            both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
            told, _ = _told(both, keys, hubs)
            large = cut(told.filter("v > u").select(*keys, F.col("v").alias("u"), F.least("_m", "u").alias("v")).filter("u <> v").distinct(), "large")
            # small star: link the smaller neighbours and the node itself to the smallest one; a node has few smaller neighbours here unless it is a hub
            _, _, hubs = _state(large, keys, hub)
            told, low = _told(large, keys, hubs)
            small = told.filter("v <> _m").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.select(*keys, "u", F.col("_m").alias("v")))
            following = StepTable(small.distinct(), "edges")
        step.drop()
        step = following
    e = step.df
    return (e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _rooted_pieces(spans: DataFrame, conn: int, keys: list[str], block: int) -> DataFrame:
    """Runs cut at block borders (p0, p1), with `root`: the id of the component's first run in raster order."""
    pieces = cut(labelled(spans, conn, keys, block), "pieces")
    roots = contract(border_links(pieces, conn, keys, block), keys).withColumnRenamed("node", "local")
    # a local component has at most the pieces of one block
    return pieces.join(roots, [*keys, "local"], "left").withColumn("root", F.coalesce("root", "local")).drop("local")


def run_components(spans: DataFrame, conn: int = 2, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Runs with `root`, the id of the component's first run in raster order."""
    kinds = dict(spans.dtypes)
    whole = _rooted_pieces(spans, conn, keys, block).filter("p0 = x0")
    return whole.select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in ("y", "x0", "x1")], "root")


def rooted_runs(mask: DataFrame, conn: int = 2, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Runs (y, x0, x1), cut at block borders, with their component's `root`."""
    pieces = _rooted_pieces(runs(mask, keys), conn, keys, block)
    return pieces.select(*keys, F.col("y").cast("int").alias("y"), F.col("p0").alias("x0"), F.col("p1").alias("x1"), "root")


def rooted_runs(mask: DataFrame, conn: int = 2, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Runs (y, x0, x1), cut at block borders, with their component's `root`."""
    pieces = _rooted_pieces(runs(mask, keys), conn, keys, block)
    return pieces.select(*keys, F.col("y").cast("int").alias("y"), F.col("p0").alias("x0"), F.col("p1").alias("x1"), "root")


def rooted_cells(mask: DataFrame, conn: int = 2, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Cells with their component root, without numbering."""
    return run_cells(rooted_runs(mask, conn, keys, block), ["root"], keys)


def number_components(rooted: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Replace `root` by ids counted from 1 in raster order within each tile."""
    rooted = cut(rooted, "rooted")
    ids = group_ordinal(rooted.select(*keys, "root").distinct(), keys, [F.col("root")], "comp")
    return rooted.join(ids.select(*keys, "root", "comp"), [*keys, "root"]).drop("root")


def components(mask: DataFrame, conn: int = 2, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Cells with component ids from 1 in raster-scan order."""
    return run_cells(number_components(run_components(runs(mask, keys), conn, keys, block), keys), ["comp"], keys)


def bboxes(comp: DataFrame, keys: list[str]) -> DataFrame:
    return comp.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def cleaned(mask: DataFrame, boxes: DataFrame, buffer: DataFrame | None, median: bool, fill: bool, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Cells (y, x, `filled`) after an optional median, the cut to the buffer and optional hole filling inside the tiles' boxes; one shuffle of cells.

    Only regions of unset cells that reach from block to block are linked over the network, and only if a box has more than one block.
    """
    out = cleaned_blocks(mask, boxes, buffer, median, fill, keys, block)
    cells = [*keys, "y", "x", "filled"]
    if not fill or boxes.filter(f"y0 div {block} < y1 div {block} or x0 div {block} < x1 div {block}").isEmpty():
        return out.select(*cells)
    out = cut(out, "cleaned")
    pieces = out.filter("local is not null").withColumn("y", F.col("y").cast("bigint")).withColumn("p0", F.col("x").cast("bigint")).withColumn("p1", F.col("x1").cast("bigint"))
    roots = contract(border_links(pieces.select(*keys, "y", "p0", "p1", "local"), 1, keys, block), keys).withColumnRenamed("node", "local")
    rooted = cut(pieces.join(roots, [*keys, "local"], "left").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").alias("x0"), "x1", "filled", "edge", F.coalesce("root", "local").alias("root")), "gap-roots")
    closed = rooted.groupBy(*keys, "root").agg(F.max("edge").alias("open")).filter("not open")
    found = run_cells(rooted.join(closed, [*keys, "root"], "left_semi"), ["filled"], keys).select(*cells)
    if buffer is not None:
        found = found.join(buffer.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    return out.filter("local is null").select(*cells).unionByName(found)


def _filled(mask: DataFrame, buffer: DataFrame | None, keys: list[str], block: int) -> DataFrame:
    """Everything outside the mask box is background that reaches the tile edge, so a region is open exactly when it reaches the box's ends."""
    mask = cut(mask.select(*keys, "y", "x"), "mask")
    boxes = cut(bboxes(mask, keys), "boxes")
    out = cleaned(mask, boxes, None, False, True, keys, block)
    return out if buffer is None else out.join(buffer.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def holes(mask: DataFrame, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Cells of enclosed background (side-connected, not reaching the outside)."""
    return _filled(mask, None, keys, block).filter("filled").drop("filled")


def fill_holes(mask: DataFrame, buffer: DataFrame | None = None, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Mask with its holes set and then clipped to the buffer; `filled` tells added cells."""
    return _filled(mask, buffer, keys, block).select(*keys, "y", "x", "filled")


def distance_to_background(comp: DataFrame, at: DataFrame | None, keys: list[str]) -> DataFrame:
    """Exact Euclidean distance of the cells `at` (all if None) to the nearest unset cell inside the object's box.

    `keys` identify an object. Column distances come from vertical runs, then each row run takes the lower envelope of its columns' parabolas, so the cost is
    linear in the cells whatever the thickness. An object that fills its box is measured to the cells just outside the box.
    """
    comp = cut(comp.select(*keys, "y", "x"), "objects")
    box = comp.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"),
                                  F.max("x").alias("_x1"), F.count(F.lit(1)).alias("_n"))
    full = F.col("_n") == (F.col("_y1") - F.col("_y0") + 1) * (F.col("_x1") - F.col("_x0") + 1)
    box = cut(box.withColumn("_pad", full.cast("int")), "boxes")
    down, across = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "y").orderBy("x")
    ends = (comp.withColumn("_g", F.col("y") - F.row_number().over(down)).groupBy(*keys, "x", "_g").agg(F.min("y").alias("_s"), F.max("y").alias("_e")).join(box, keys))
    cells = ends.withColumn("y", F.explode(F.sequence("_s", "_e")))
    above = F.when(F.col("_s") - 1 >= F.col("_y0") - F.col("_pad"), F.col("y") - F.col("_s") + 1)
    below = F.when(F.col("_e") + 1 <= F.col("_y1") + F.col("_pad"), F.col("_e") + 1 - F.col("y"))
    cells = cells.select(*keys, "y", "x", F.coalesce(F.least(above, below), F.lit(-1)).cast("bigint").alias("g"), (F.col("_x0") - F.col("_pad")).alias("_x0"), (F.col("_x1") + F.col("_pad")).alias("_x1"))
    placed = cells.repartition(*keys, "y").withColumn("_r", F.col("x") - F.row_number().over(across))  # rows stay where they are from here on
    run = Window.partitionBy(*keys, "y", "_r")
    rows = (placed.withColumn("run", F.min("x").over(run)).withColumn("_end", F.max("x").over(run))
            .withColumn("open_left", F.col("run") - 1 >= F.col("_x0")).withColumn("open_right", F.col("_end") + 1 <= F.col("_x1")))
    cell = [*keys, "y", "x"]
    out = row_distances(rows.select(*cell, "run", "g", "open_left", "open_right"), keys, cell).select(*cell, F.sqrt(F.col("d2").cast("double")).alias("dist"))
    return out if at is None else out.join(at.select(*cell), cell, "left_semi")


def skeleton(comp: DataFrame, keys: list[str], block: int = BLOCK, halo: int | None = None) -> DataFrame:
    """Two-subpass thinning (Zhang and Suen, 1984) of all objects at once, many rounds for each shuffle; an object leaves once a round changes nothing in it."""
    kinds = dict(comp.dtypes)
    more = {} if halo is None else {"halo": halo}
    key, out = [*keys, "_by", "_bx"], []
    step = StepTable(thinning_step(comp.select(*keys, "y", "x"), keys, block, **more), "thin")
    while True:
        blocks = cut(step.df.groupBy(*key).agg(F.max("moving").alias("moving")), "blocks")
        objects = blocks.groupBy(*keys).agg(F.max("moving").alias("live"))
        state = cut(blocks.drop("moving").join(objects, keys), "state")
        if not state.agg(F.max("live")).first()[0]:
            out.append(step.df)
            break
        # the key holds a block, so a giant object's cells are joined in many tasks
        cells = step.df.join(state, key)
        out.append(cut(cells.filter("not live").select(*keys, "y", "x"), "thinned"))
        following = StepTable(thinning_step(cells.filter("live").select(*keys, "y", "x"), keys, block, **more), "thin")
        step.drop()
        step = following
    done = out[0].select(*keys, "y", "x")
    for part in out[1:]:
        done = done.unionByName(part.select(*keys, "y", "x"))
    return done.select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in ("y", "x")])
