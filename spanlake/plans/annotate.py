"""The full deterministic pass over proposal tables: assemble, subdivide, repeat, clean, refine, label."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.operators import clean as cl
from spanlake.operators import proposals as pr
from spanlake.operators.layout import divide, durable, hot_groups


@dataclass(frozen=True)
class Config:
    """The knobs that change results; model and image settings stay with whoever serves the model."""

    name: str = "balanced"
    segment_input: str = "sheets"
    interval: float = schema.GRID_INTERVAL
    subdivide: bool = True
    subdivide_input: str = "sheets"
    label: bool = True
    refine: bool = False
    refine_input: str = "sheets"
    refine_half_window: float = schema.REFINE_HALF_WINDOW
    repeat_pass: bool = False

    def as_columns(self) -> dict:
        """The settings as literal columns, to stamp onto a result."""
        return {f"config_{k}": F.lit(v) for k, v in asdict(self).items()}


PRESETS = {
    "fast": Config(name="fast", subdivide=False, label=False),
    "balanced": Config(name="balanced", subdivide=False),
    "strict": Config(name="strict", refine=True, repeat_pass=True),
}


@dataclass
class Tables:
    """Inputs of one pass. ``windows`` describes what each proposal row was shown."""

    episodes: DataFrame
    requests: DataFrame
    proposals: DataFrame
    windows: DataFrame
    grid: DataFrame | None = None
    second: DataFrame | None = None
    pieces: DataFrame | None = None
    choices: DataFrame | None = None
    labels: DataFrame | None = None


def _annotate_by_size(tables: Tables, cfg: Config) -> cl.Cleaned:
    """Large episodes through the split plan, all others through windows."""
    keys = list(schema.EPISODE_KEYS)
    sized = [t for t in (tables.proposals, tables.second, tables.pieces, tables.grid) if t is not None]
    hot = hot_groups(sized, keys)
    if hot is None:
        return annotate(tables, cfg, split=False)
    parts = {f.name: divide(getattr(tables, f.name), hot, keys) for f in fields(tables) if getattr(tables, f.name) is not None}
    small, large = (annotate(Tables(**{name: p[k] for name, p in parts.items()}), cfg, split=bool(k)) for k in (0, 1))
    return small.together(large)


def annotate(tables: Tables, quality: str | Config = "balanced", split: bool | None = None) -> cl.Cleaned:
    """(segments, warnings). Stages the preset leaves out are left out of the plan."""
    cfg = PRESETS[quality] if isinstance(quality, str) else quality
    if split is None:
        return _annotate_by_size(tables, cfg)
    t = tables
    keys = list(schema.EPISODE_KEYS)

    def coarse(proposals: DataFrame) -> DataFrame:
        return pr.assemble(proposals, t.windows, cfg.segment_input, keys, t.grid, cfg.interval, split)

    # Written where several later steps read it, so that nothing is assembled twice.
    spans = durable(coarse(t.proposals))
    if cfg.subdivide and t.pieces is not None:
        spans = pr.apply_subdivision(spans, t.pieces, keys, cfg.subdivide_input == "video", split)
    segments, notes = cl.to_segments(spans), []
    if cfg.repeat_pass and t.second is not None:
        segments, unstable = cl.flag_unstable(segments, coarse(t.second), keys, split)
        notes.append(lambda: unstable.select(*keys, F.lit(3).alias("stage"), "warning"))
    first = cl.clean(segments, t.episodes, t.requests, split=split)
    segments = first.segments
    notes.append(lambda: first.warnings.select(*keys, F.lit(1).alias("stage"), "warning"))
    if cfg.refine and t.choices is not None:
        segments = durable(segments)
        segments, moved = pr.apply_refinement(segments, t.choices, t.episodes, keys, cfg.refine_half_window,
                                              mode=cfg.refine_input, split=split)
        notes.append(lambda: moved.select(*keys, F.lit(4).alias("stage"), "warning"))
    if cfg.label and t.labels is not None:
        segments = pr.apply_labels(segments, t.labels, t.requests)
        more = cl.clean(segments, t.episodes, t.requests, split=split)
        segments = more.segments
        notes.append(lambda: more.warnings.select(*keys, F.lit(2).alias("stage"), "warning"))
    return cl.Cleaned(segments, lambda: reduce(DataFrame.unionByName, (note() for note in notes)))
