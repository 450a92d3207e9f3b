"""Patch-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extractors, vectors
from ..operators import features, texture
from ..operators.tiling import blocks, repeat_blocks, windows
from ..plans.scratch import cut
from ..sources import stores
from .data import PS, SIZE, STRIDE, cells, cells01, dense, placed01, query, r6, tiles, vecs
from .masks import GRADIENT, LBP
from .scalars import HSV, SAT
from .sources import stored

KEY = ["tile_id", "win_y", "win_x", "py", "px"]
KEYS = "tile_id, win_y, win_x, py, px"


def long(df, col, *keys):
    return df.select(*keys, F.posexplode(col).alias("dim", "v")).select(*keys, "dim", *r6("v"))


def blocks01(spark, d):
    """Dense cells in blocks of one patch: windows start at whole patches, so a patch's features are those of its block."""
    return blocks(dense(spark, d).withColumns({c: F.col(c) / F.lit(255.0) for c in "rgb"}), PS)


def repeated(spark, d, df):
    return repeat_blocks(df, tiles(spark, d), SIZE, STRIDE, PS)


@query("FEA-01", """SELECT vec_id, CAST(p AS INT) AS patch, CAST(c AS INT) AS dim, ROUND(v / (SQRT(SUM(v * v) OVER (PARTITION BY vec_id, p)) + 1e-8), 6) AS v FROM
    (SELECT vec_id, p, c, (vec[(p + 2) * 8 + c + 1] + vec[64 - ((p + 2) * 8 + c)]) / 2 AS v FROM vecs, unnest(range(6)) a(p), unnest(range(8)) b(c))""")
def _(spark, d):
    """A vector of 64 as 8 tokens of 8 channels (2 leading tokens dropped), with the reversed vector as a second layer."""
    v = vecs(spark, d)

    def tokens(x):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, F.lit(8)))

    table_ = v.select("vec_id", F.array(tokens(vectors.to_double(F.col("vec"))), tokens(F.reverse(vectors.to_double(F.col("vec"))))).alias("tokens"))
    return long(features.ingest_embeddings(table_, "tokens", 2, [0, 1]), "vec", "vec_id", "patch")


@query("FEA-02", """SELECT vec_id, CAST(i - 1 AS INT) AS dim, ROUND(vec[i] * 3 / (SQRT(list_dot_product(vec, vec)) * 3 + 1e-8), 6) AS v FROM vecs, unnest(range(1, 65)) r(i)""")
def _(spark, d):
    return long(vecs(spark, d).withColumn("vec", vectors.l2(vectors.scale(F.col("vec"), 3.0))), "vec", "vec_id")


@query("FEA-03", f"""SELECT {KEYS}, ROUND(AVG(r), 6) AS r_mean, ROUND(AVG(g), 6) AS g_mean, ROUND(AVG(b), 6) AS b_mean, ROUND(stddev_pop(r), 6) AS r_std,
    ROUND(stddev_pop(g), 6) AS g_std, ROUND(stddev_pop(b), 6) AS b_std FROM placed01 GROUP BY ALL""")
def _(spark, d):
    return repeated(spark, d, features.rgb_stats(blocks01(spark, d))).select(*KEY, *r6("r_mean", "g_mean", "b_mean", "r_std", "g_std", "b_std"))


@query("FEA-04", f"""SELECT {KEYS}, ROUND(AVG({HSV}), 6) AS h_mean, ROUND(AVG({SAT}), 6) AS s_mean, ROUND(AVG(mx), 6) AS v_mean FROM
    (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM placed01) GROUP BY ALL""")
def _(spark, d):
    return repeated(spark, d, features.hsv_mean(blocks01(spark, d))).select(*KEY, *r6("h_mean", "s_mean", "v_mean"))


@query("FEA-05", f"SELECT {KEYS}, ROUND(AVG(SQRT(gx * gx + gy * gy)), 6) AS mag_mean, ROUND(stddev_pop(SQRT(gx * gx + gy * gy)), 6) AS mag_std FROM {GRADIENT} GROUP BY ALL")
def _(spark, d):
    return texture.patch_gradients(cells01(spark, d), tiles(spark, d), SIZE, STRIDE, PS).select(*KEY, *r6("mag_mean", "mag_std"))


@query("FEA-06", f"""WITH m AS (SELECT {KEYS}, SQRT(gx * gx + gy * gy) AS mag, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END AS ori FROM {GRADIENT}),
    h AS (SELECT {KEYS}, greatest(0, least(7, CAST(floor(ori / (2 * pi()) * 8) AS INT))) AS bin, SUM(mag) AS w FROM m GROUP BY ALL),
    p AS (SELECT {KEYS}, SUM(w) AS total FROM h GROUP BY ALL)
    SELECT p.tile_id, p.win_y, p.win_x, p.py, p.px, CAST(k AS INT) AS dim, ROUND(COALESCE(w, 0) / (total + 1e-8), 6) AS v FROM p CROSS JOIN unnest(range(8)) r(k)
    LEFT JOIN h ON h.tile_id = p.tile_id AND h.win_y = p.win_y AND h.win_x = p.win_x AND h.py = p.py AND h.px = p.px AND bin = k""")
def _(spark, d):
    return long(texture.patch_orientations(cells01(spark, d), tiles(spark, d), SIZE, STRIDE, PS, 8), "hist", *KEY)


@query("FEA-07", f"""WITH h AS (SELECT {KEYS}, code * 16 // 256 AS bin, COUNT(*) AS w FROM {LBP} GROUP BY ALL), p AS (SELECT DISTINCT {KEYS} FROM placed),
    t AS (SELECT {KEYS}, SUM(w) AS total FROM h GROUP BY ALL)
    SELECT p.tile_id, p.win_y, p.win_x, p.py, p.px, CAST(k AS INT) AS dim, ROUND(COALESCE(w, 0) / (COALESCE(total, 0) + 1e-8), 6) AS v FROM p CROSS JOIN unnest(range(16)) r(k)
    LEFT JOIN t ON t.tile_id = p.tile_id AND t.win_y = p.win_y AND t.win_x = p.win_x AND t.py = p.py AND t.px = p.px
    LEFT JOIN h ON h.tile_id = p.tile_id AND h.win_y = p.win_y AND h.win_x = p.win_x AND h.py = p.py AND h.px = p.px AND bin = k""")
def _(spark, d):
    return long(features.lbp_hist(features.with_texture(placed01(spark, d)), 16), "hist", *KEY)


@query("FEA-08", f"""WITH f AS (SELECT {KEYS}, AVG(r) AS rm, AVG(g) AS gm, AVG(b) AS bm, stddev_pop(r) AS rs, stddev_pop(g) AS gs, stddev_pop(b) AS bs,
    AVG({HSV}) AS h, AVG({SAT}) AS s, AVG(mx) AS v FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM placed01) GROUP BY ALL),
    c AS (SELECT {KEYS}, [rm * 0.5, gm * 0.5, bm * 0.5, rs * 0.5, gs * 0.5, bs * 0.5, h * 0.4, s * 0.4, v * 0.4]::DOUBLE[] AS vec FROM f)
    SELECT {KEYS}, CAST(i - 1 AS INT) AS dim, ROUND(vec[i] / (SQRT(list_dot_product(vec, vec)) + 1e-8), 6) AS v FROM c, unnest(range(1, 10)) u(i)""")
def _(spark, d):
    p = cut(blocks01(spark, d), "blocks")
    rgb = features.rgb_stats(p).select(*KEY, F.array("r_mean", "g_mean", "b_mean", "r_std", "g_std", "b_std").alias("rgb_stats"))
    hsv = features.hsv_mean(p).select(*KEY, F.array("h_mean", "s_mean", "v_mean").alias("hsv_mean"))
    fused = features.fuse_blocks(rgb.join(hsv, KEY), features.KNN_WEIGHTS, True)
    return long(repeated(spark, d, fused), "vec", *KEY)


STATS = "(SELECT i, AVG(vec[i]) AS m, greatest(stddev_pop(vec[i]), 1e-6) AS s FROM vecs, unnest(range(1, 65)) r(i) GROUP BY 1)"


@query("FEA-10", f"SELECT CAST(i - 1 AS INT) AS dim, ROUND(m, 6) AS mean, ROUND(s, 6) AS std FROM {STATS}")
def _(spark, d):
    stats = features.zscore_fit(vecs(spark, d))
    return stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select("dim", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query("FEA-11", f"SELECT vec_id, CAST(i - 1 AS INT) AS dim, ROUND((vec[i] - m) / s, 6) AS v FROM vecs CROSS JOIN {STATS}")
def _(spark, d):
    v = vecs(spark, d)
    return long(features.zscore_apply(v, features.zscore_fit(v)), "vec", "vec_id")


@query("FEA-13", """WITH s AS (SELECT DISTINCT tile_id, win_y, win_x FROM placed WHERE w_eff // 4 = least(16, 31 - win_x) // 4), n AS (SELECT COUNT(*) AS n FROM s)
    SELECT w.tile_id, w.win_y, w.win_x, n AS cached, (SELECT COUNT(*) FROM wins) - n AS computed, ROUND(n / CAST((SELECT COUNT(*) FROM wins) AS DOUBLE), 6) AS hit_ratio
    FROM wins w ANTI JOIN s USING (tile_id, win_y, win_x) CROSS JOIN n""")
def _(spark, d):
    t = tiles(spark, d)
    narrow = windows(t.withColumn("width", F.lit(31)), SIZE, STRIDE).select(
        F.col("tile_id").alias("image_id"), "win_y", "win_x", F.expr("cast(h_eff div 4 as int)").alias("hp"), F.expr("cast(w_eff div 4 as int)").alias("wp"))
    good = stores.valid_features(stored(spark, d), "new", PS, 1, narrow).withColumnRenamed("image_id", "tile_id")
    asked = windows(t, SIZE, STRIDE).select("tile_id", "win_y", "win_x")
    ratio = features.hit_ratio(asked, good).select("cached", "computed", F.round("hit_ratio", 6).alias("hit_ratio"))
    return features.missing_features(asked, good).join(F.broadcast(ratio))


@query("UDF-01", f"SELECT {KEYS}, ROUND(AVG(r), 3) AS r_mean, ROUND(AVG(b), 3) AS b_mean FROM placed GROUP BY ALL")
def _(spark, d):
    def mean_colour(images, ps):
        n, h, w, c = images.shape
        return images.reshape(n, h // ps, ps, w // ps, ps, c).mean(axis=(2, 4), dtype="float64")

    out = extractors.with_extractor(extractors.tile_images(cells(spark, d), tiles(spark, d), SIZE, STRIDE), mean_colour, PS)
    return out.select(*KEY, F.round(F.col("vec")[0].cast("double"), 3).alias("r_mean"), F.round(F.col("vec")[2].cast("double"), 3).alias("b_mean"))
