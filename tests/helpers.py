"""Small grids as tables and back, and plain NumPy definitions to compare with."""

from __future__ import annotations

import numpy as np


def tiles(spark, *shapes):
    rows = [(i, h, w, 0.0, float(h), 1.0) for i, (h, w) in enumerate(shapes)]
    return spark.createDataFrame(rows, "tile_id int, height int, width int, left double, top double, px double")


def mask_df(spark, *grids):
    rows = [(i, int(y), int(x)) for i, g in enumerate(grids) for y, x in np.argwhere(np.asarray(g))]
    return spark.createDataFrame(rows, "tile_id int, y int, x int")


def grid_of(df, shape, tile=0, value=None):
    out = np.zeros(shape, dtype=float if value else bool)
    for r in df.collect():
        if r["tile_id"] == tile:
            out[r["y"], r["x"]] = r[value] if value else True
    return out


def dense_df(spark, columns: dict[str, np.ndarray], tile=0):
    names = list(columns)
    h, w = next(iter(columns.values())).shape
    rows = [(tile, y, x, *[columns[n][y, x].item() for n in names]) for y in range(h) for x in range(w)]
    kinds = {"b": "boolean", "i": "int", "f": "double"}
    schema = "tile_id int, y int, x int, " + ", ".join(f"{n} {kinds[columns[n].dtype.kind]}" for n in names)
    return spark.createDataFrame(rows, schema)


def blobs(seed, h=24, w=20, p=0.5):
    rng = np.random.default_rng(seed)
    noise = rng.random((h, w)) < p
    pad = np.pad(noise, 1).astype(int)
    near = sum(pad[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return near >= 5


def label_components(g, conn):
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if conn > 1 else [])
    out, n = np.zeros(g.shape, int), 0
    for y, x in np.argwhere(g):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        out[y, x] = n
        while stack:
            a, b = stack.pop()
            for dy, dx in steps:
                c, e = a + dy, b + dx
                if 0 <= c < g.shape[0] and 0 <= e < g.shape[1] and g[c, e] and not out[c, e]:
                    out[c, e] = n
                    stack.append((c, e))
    return out


def disk_dilate(g, r):
    out = np.zeros_like(g)
    for y, x in np.argwhere(g):
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy * dy + dx * dx <= r * r and 0 <= y + dy < g.shape[0] and 0 <= x + dx < g.shape[1]:
                    out[y + dy, x + dx] = True
    return out


def box_distance(g):
    """Distance of set cells to unset ones inside the box of `g` (just outside it for a full box)."""
    ys, xs = np.nonzero(g)
    y0, y1, x0, x1 = ys.min(), ys.max(), xs.min(), xs.max()
    sub = g[y0:y1 + 1, x0:x1 + 1]
    if sub.all():
        sub, y0, x0 = np.pad(sub, 1), y0 - 1, x0 - 1
    bg = np.argwhere(~sub)
    return {(y, x): float(np.sqrt(((bg - [y - y0, x - x0]) ** 2).sum(1).min())) for y, x in zip(ys, xs)}


def thin(g):
    g = g.copy()
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = g.sum()
        for sub in (0, 1):
            p = np.pad(g, 1)
            drop = []
            for y, x in np.argwhere(g):
                v = [int(p[y + 1 + dy, x + 1 + dx]) for dy, dx in ring]
                n, e, s, w = v[0], v[2], v[4], v[6]
                turns = sum(a == 0 and b == 1 for a, b in zip(v, v[1:] + v[:1]))
                rule = (n * e * s == 0 and e * s * w == 0) if sub == 0 else (n * e * w == 0 and n * s * w == 0)
                if 2 <= sum(v) <= 6 and turns == 1 and rule:
                    drop.append((y, x))
            for y, x in drop:
                g[y, x] = False
        if g.sum() == before:
            return g
