"""Tables and parameters of the match-tracking engine. Every table is keyed by match_id; a missing box is NULL, never NaN."""

from __future__ import annotations

from dataclasses import dataclass

BOX = "x1 double, y1 double, x2 double, y2 double"
MATCHES = "match_id bigint, fps double, total_frames bigint, frame_w int, frame_h int"
COURT_KEYPOINTS = "match_id bigint, class_idx int, class_name string, kp_idx int, x double, y double"
PLAYER_DET = f"match_id bigint, frame_num bigint, track_id bigint, {BOX}"
BALL_CAND = f"match_id bigint, frame_num bigint, cand_idx int, conf double, {BOX}"
BALL_DET = f"match_id bigint, frame_num bigint, {BOX}"
PLAYER_SLOT = f"match_id bigint, frame_num bigint, player_id int, slot_ord int, {BOX}"
POSITIONS = "match_id bigint, frame_num bigint, entity string, player_id int, slot_ord int, mx int, my int"
SHOTS = "match_id bigint, shot_idx bigint, frame_num bigint"
HIGHLIGHT = "start_frame: bigint, end_frame: bigint, timestamp_seconds: double, label: string"
JOB_EVENTS = "job_id string, seq bigint, status string, stage string, progress int, result string, error string, at timestamp_ntz"
JOB_COMMANDS = "job_id string, seq bigint, command string, status string, stage string, progress int, result string, error string, at timestamp_ntz"
JOB_STATE = "job_id string, status string, stage string, progress int, result string, error string, created_at timestamp_ntz, updated_at timestamp_ntz"


@dataclass(frozen=True)
class Params:
    """Thresholds of the analysis (fixed values but for `span`), all adjustable."""

    default_fps: float = 24.0
    gap_limit: int = 90
    roll: int = 5
    min_persist: int = 5
    max_persist: int = 25
    persist_divisor: int = 20
    look_ahead: float = 1.2
    ball_min_size: float = 1.0
    ball_max_size: float = 150.0
    ball_max_jump: float = 800.0
    ball_lost_reset: int = 5
    court_pad: float = 200.0
    slot_accept: float = 300.0
    n_players: int = 4
    smash_share: float = 0.4
    rally_shots: int = 5
    rally_gap_seconds: float = 3.0
    clip_frames: int = 60
    merge_frames: int = 30
    court_width_m: float = 10.0
    court_length_m: float = 20.0
    grid: int = 100
    sigma: int = 5
    min_positions: int = 50
    feet_margin: float = 0.08
    min_court_w: float = 400.0
    min_court_h: float = 200.0
    #: Frames of a range, where matches are too long for a task (operators.ranges); no threshold, results are the same.
    span: int | None = None


DEFAULT = Params()
