"""The per-tile inference chain as one plan over all tiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import proposals, refine
from ..operators.focal import dilate
from ..operators.tiling import TILE
from .scratch import cut


@dataclass(frozen=True)
class ChainConfig:
    threshold: float = 0.5
    penalty: float = 0.8
    prior_inside: float = 1.0
    prior_outside: float = 1.0
    prior_max: float | None = 1.0
    use_prior: bool = False
    fill_holes: bool = True
    crf: refine.PairwiseConfig | None = None
    shadow_weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    shadow_threshold: float = 60.0
    protect: float | None = 0.6
    pixel_m: float = 1.0
    proposal: proposals.ProposalConfig = field(default_factory=proposals.ProposalConfig)


def adjusted_score(ctx: DataFrame, cfg: ChainConfig) -> DataFrame:
    """Road penalty first, then the inference-only prior."""
    s = scores.penalise(F.col("score"), F.col("road"), cfg.penalty)
    if cfg.use_prior:
        s = scores.prior(s, F.col("label"), cfg.prior_inside, cfg.prior_outside, cfg.prior_max)
    return ctx.withColumn("score", s)


def infer_tiles(ctx: DataFrame, tiles: DataFrame, cfg: ChainConfig, keys: list[str] = TILE, preview: bool = False) -> DataFrame:
    """Masks of every tile in long form: variant raw, crf, shadow, shadow_with_proposals.

    `ctx` is the dense tile context with score, r, g, b and booleans label, buffer, road. `preview` keeps the masks unclipped, but for a `crf` variant without refinement.
    """
    cell = [*keys, "y", "x"]
    ctx = cut(adjusted_score(ctx, cfg), "context")
    buffer = None if preview else ctx.filter("buffer").select(*cell)
    raw = cut(refine.stream_mask(ctx, F.col("score"), cfg.threshold, tiles, buffer, cfg.fill_holes, keys), "raw")
    refined = raw
    if cfg.crf is not None:
        dense = ctx.drop("buffer") if preview else ctx
        if cfg.crf.trimap_band > 0:
            ring = dilate(raw, tiles, cfg.crf.trimap_band, "ellipse", keys)
            dense = (dense.join(raw.select(*cell, F.lit(True).alias("seed")), cell, "left")
                     .join(ring.select(*cell, F.lit(True).alias("wide")), cell, "left").fillna(False, ["seed", "wide"]))
        prepared = refine.unary(dense, cfg.crf, cfg.threshold, dilated="wide", seed="seed")
        refined = cut(refine.pairwise_refine(prepared, cfg.crf, keys).filter("mask").select(*cell), "crf")

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("variant"), *cell)

    if preview:
        if cfg.crf is None:  # without refinement the preview falls back to the active mask, which is clipped
            refined = refine.stream_mask(ctx, F.col("score"), cfg.threshold, tiles, ctx.filter("buffer").select(*cell), cfg.fill_holes, keys)
        return named(raw, "raw").unionByName(named(refined, "crf"))
    keep = scores.bright_enough(cfg.shadow_weights, cfg.shadow_threshold, F.col("r"), F.col("g"), F.col("b"), F.col("score"), cfg.protect)
    shadow = cut(ctx.filter(keep).select(*cell).join(refined, cell, "left_semi"), "shadow")
    cand = proposals.candidates(ctx.filter(F.col("score") >= cfg.threshold), ctx.filter("label"), ctx.filter("buffer"), keys=keys)
    cells = cut(proposals.objects(cand, cfg.proposal.connectivity, keys).join(ctx.select(*cell, "score", "road"), cell), "objects")
    verdicts = proposals.evaluate(cells, cfg.proposal, cfg.pixel_m, keys)
    accepted = proposals.proposal_masks(cells, verdicts, cfg.proposal, keys).filter("variant = 'accepted_mask'")
    return (named(raw, "raw").unionByName(named(refined, "crf")).unionByName(named(shadow, "shadow"))
            .unionByName(named(proposals.with_proposals(shadow, accepted, keys), "shadow_with_proposals")))
