"""Parameters of the model and of the roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Model:
    """Walking model. Speeds in m/s, slopes as rise over run."""

    segment_m: float = 30.0
    snap_m: float = 1.0
    keep_share: float = 0.05
    stair_connect_m: float = 15.0
    origin_snap_m: float = 60.0
    dest_snap_m: float = 100.0
    bridge_m: float = 10.0
    slope_clip: float = 0.40
    elder_speed: float = 0.8
    adult_speed: float = 1.1
    stair_factor: float = 1.2
    downhill_weight: float = 0.5
    wheel_speed: float = 1.0
    wheel_limit: float = 1 / 12
    wheel_steep_penalty: float = 10.0
    edge_buffer_m: float = 500.0
    edge_cell_m: float = 50.0
    band_mid: float = 1.3
    band_high: float = 1.8
    grid_m: int = 250
    coarse_grid_m: int = 500
    min_count: int = 5
    benefit_s: float = 60.0
    isochrone_buffer_m: float = 25.0
    siting_buffer_m: float = 30.0
    residential_cell_m: float = 25.0

    def but(self, **changes) -> Model:
        return replace(self, **changes)


DEFAULT = Model()

#: What-if scenarios: name -> changed parameters.
SENSITIVITY = {
    "speed_0.7": {"elder_speed": 0.7},
    "speed_1.0": {"elder_speed": 1.0},
    "downhill_0": {"downhill_weight": 0.0},
    "downhill_1": {"downhill_weight": 1.0},
    "stairs_1.5": {"stair_factor": 1.5},
    "clip_0.3": {"slope_clip": 0.30},
}

# Default waiting time (s) and speed (m/s) of facility types.
FACILITY = {"elevator": (60.0, 1.0), "monorail": (60.0, 0.6), "vertical": (45.0, 1.0), "ramp": (0.0, 0.8)}


@dataclass(frozen=True)
class Codes:
    """Attribute codes of the source layers."""

    residential_use: tuple = ("BDU001", "BDU002")
    residential_kind: tuple = ("BDC001", "BDC002", "BDC003")
    medical_use: tuple = ("BDU009",)
    elderly_use: tuple = ("BDU011",)
    stair_kind: str = "PGS001"
    use_classes: dict = field(default_factory=lambda: {"home": ("BDU001", "BDU002"), "shop": ("BDU003", "BDU004", "BDU007"), "medical": ("BDU009",), "elderly": ("BDU011",)})
    parcel_classes: dict = field(default_factory=lambda: {"road": ("도로", "도"), "park": ("공원", "공"), "plot": ("대",), "forest": ("임야", "임"), "school": ("학교용지", "학"), "stream": ("하천", "천", "구거", "구")})


CODES = Codes()
