"""Column conventions, reader schemas and the constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

# A scored unit is one episode of one run; gold spans and requests belong to the episode alone.
RUN_KEYS = ("run", "episode_id")
EPISODE_KEYS = ("episode_id",)

# Scoring thresholds (seconds and IoU), all inclusive.
TOLERANCES = (0.25, 0.5, 1.0, 2.0)
IOU_THRESHOLDS = (0.1, 0.25, 0.5, 0.75)
DURATION_EDGES = (1.0, 2.0, 4.0, 8.0)
TAXONOMY_EDGES = (2.0, 4.0, 8.0)
SNAPPED_IOU = 0.75

# Failure taxonomy.
TAXONOMY = ("ok", "merged", "split", "shifted", "missing")
COVERAGE_CUT = 0.7
SHIFTED_CUT = 0.2

# Cleaning and assembly.
MIN_DURATION = 0.15
MIN_PIECE = 0.4
SUBDIVIDE_MIN_SPAN = 3.0
SUBDIVIDE_INTERVAL = 0.25
SUBDIVIDE_MAX_FRAMES = 168
SUBDIVIDE_MIN_FRAMES = 4
REFINE_HALF_WINDOW = 1.5
REFINE_INTERVAL = 0.25
REFINE_FLAG = 0.75
REFINE_GUARD = 0.05
LABEL_CONTEXT = 1.0
LABEL_MAX_FRAMES = 20
MIN_RUN = 2
NO_EVENT_LABEL = "no_completed_subtask"
NONE_LABELS = ("", "none", "null", "idle", "no subtask", "n/a", "-")
STOPWORDS = ("the", "a", "an", "to", "on", "in", "of", "up", "down", "and", "with", "at", "into")
DISAGREEMENT = 0.34
RESULTS = ("pass", "fail", "unknown")
CONFIDENCES = ("high", "medium", "low")
QUALITIES = ("fast", "balanced", "strict")
EPS = 1e-6

# Sampling grid and windows.
GRID_INTERVAL = 0.5
FRAMES_PER_SHEET = 20
SHEET_COLUMNS = 5
SHEETS_PER_WINDOW = 6
SHEET_OVERLAP = 1
CLIP_WINDOW = 60.0
CLIP_OVERLAP = 5.0

# Statistics and reports.
BOOTSTRAP = 4000
SEED = 20260827
ALPHA = 0.05
JUDGE_BATCH = 20
DEFAULT_PRICE = (0.75, 3.75)

_double, _long, _string = T.DoubleType(), T.LongType(), T.StringType()
STRINGS = T.ArrayType(_string)


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SPANS = struct(run=_string, episode_id=_string, idx=_long, start_s=_double, end_s=_double, label=_string)

SEGMENTS = struct(
    episode_id=_string, start_s=_double, end_s=_double, label=_string, result=_string,
    attributes=STRINGS, description=_string, confidence=_string, flags=STRINGS)

GOLD_ITEM = struct(start_sec=_double, end_sec=_double, subtask=_string)

BENCHMARK = struct(
    id=_string, instruction=_string, video=T.BinaryType(), segments=T.ArrayType(GOLD_ITEM),
    metadata=_string, perception_state=struct(robot_family=_string))

SIDECAR = struct(
    id=_string, instruction=_string, segments=T.ArrayType(GOLD_ITEM), family=_string,
    metadata=T.MapType(_string, _string))

USAGE = struct(calls=_long, prompt_tokens=_long, output_tokens=_long, retries=_long,
               by_stage=T.MapType(_string, _long))

# Run-file triples mix numbers and text, so they are read as text and cast.
RUN_ROW = struct(
    id=_string, family=_string, ok=T.BooleanType(), elapsed=_double, duration=_double,
    pred=T.ArrayType(STRINGS), gold=T.ArrayType(STRINGS), warnings=STRINGS, error=_string, usage=USAGE)

RUN_FILE = struct(
    tag=_string, dataset=_string, model=_string, quality=_string, episodes=_long, failed=_long,
    wall_seconds=_double, video_seconds=_double, rows=T.ArrayType(RUN_ROW))

SIMULATOR_STEPS = struct(
    episode_id=_string, high_level_instruction=_string,
    steps=T.ArrayType(struct(timestep=struct(start=_long, end=_long), subtask_description=_string)))

TRACK_SEGMENT = struct(track=_string, instruction=_string, skill=_string,
                       start_frame_index=_long, end_frame_index=_long)

INSTRUCTION_TRACKS = struct(
    archive=_string, fps=_double,
    instruction_segments=T.MapType(_string, T.ArrayType(TRACK_SEGMENT)),
    h5_path=T.MapType(_string, _string))

# Object lists nest one level deeper for compound substances, so each entry is kept as JSON text.
SKILL_ANNOTATIONS = struct(
    episode_id=_string,
    skill_annotation=T.ArrayType(struct(
        frame_duration=T.ArrayType(_long), skill_description=STRINGS, object_id=T.ArrayType(STRINGS),
        memory_prefix=STRINGS, spatial_prefix=STRINGS, manipulating_object_id=STRINGS)),
    meta_data=struct(valid_duration=T.ArrayType(_long)))

SESSION_EVENTS = struct(
    video_name=_string, taskType=_string,
    events=T.ArrayType(struct(label=_string, start=_double, end=_double,
                              attributes=T.MapType(_string, _string))))
