"""Thresholds of the study, one frozen record."""

from __future__ import annotations

from dataclasses import dataclass

# Local zone of the data and the dates counted as holidays.
LOCAL_TZ = "America/Sao_Paulo"
HOLIDAYS_MMDD = (
    "01-01", "01-25", "04-21", "05-01", "07-09", "09-07",
    "10-12", "11-02", "11-15", "11-20", "12-25",
)


@dataclass(frozen=True)
class Params:
    # arrivals
    min_track_points: int = 25
    track_gap_s: int = 900
    backward_m: float = 1500.0
    off_route_m: float = 150.0
    stop_off_route_m: float = 120.0
    arrival_radius_m: float = 90.0
    soft_jump_m: float = 500.0
    soft_jump_s: float = 120.0
    hard_jump_m: float = 1200.0
    hard_jump_s: float = 300.0
    max_speed_kmh: float = 80.0
    feed_coverage: float = 0.5
    # delay
    min_confidence_delay: float = 0.4
    min_segment_s: float = 5.0
    max_segment_s: float = 3600.0
    min_reference: int = 5
    late_ratio: float = 0.20
    # forecast matching
    min_confidence_match: float = 0.35
    horizon_max_s: int = 3600
    past_tolerance_s: int = 60
    error_max_s: int = 2700
    late_error_s: int = 300
    early_error_s: int = -60
    # features
    recent_s: int = 1800
    train_share: float = 0.7
    validation_share: float = 0.15
    # clustering
    eps_m: float = 400.0
    eps_s: float = 1800.0
    min_points: int = 10
