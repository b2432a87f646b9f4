"""Parameters of the domain plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VoyageParams:
    """Study window and thresholds of the voyage plans (fixed values as defaults)."""

    minimum: str = "2012-01-01"
    maximum: str = "2019-12-31"
    min_port_stop_hr: float = 0.0
    min_trip_duration_hr: float = 2.0
    noise_anchorage: str = "10000001"
    canal: str = "PANAMA CANAL"
    earliest_time: str = "1900-01-01"
    latest_time: str = "2099-12-31"


@dataclass(frozen=True)
class EncounterParams:
    """Thresholds of the carrier plans (fixed values as defaults)."""

    last_event: str = "2019-12-31"
    carrier_first_seen: str = "2019-12-31"
    carrier_confidence: int = 3
    excluded_carriers: tuple[str, ...] = ("111111111", "0", "888888888", "416202700")
    max_spoofing: float = 0.05
    anchorage_distance_m: float = 10_000.0


@dataclass(frozen=True)
class LoiteringParams:
    min_hours: float = 8.0
    min_shore_nm: float = 20.0
    max_speed_knots: float = 2.0


@dataclass(frozen=True)
class PortStopParams:
    """Pause between stops, and the range of day shards of the study, both ends included.

    Without bounds, tables need not be sharded.
    """

    short_gap_min: int = 30
    first_shard: str | None = None
    last_shard: str | None = None


# The shard ranges of the two port studies.
STOP_STUDY_SHARDS = ("20120101", "20191231")
VISIT_STUDY_SHARDS = ("20150101", "20201231")
