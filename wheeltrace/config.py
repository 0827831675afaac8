"""Thresholds and registries. Defaults are the published values; every operator takes them as parameters."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    sample_rate: float = 100.0
    debounce_s: float = 1.0
    min_event_gap_s: float = 2.0
    min_adas_s: float = 2.0
    min_human_s: float = 1.0
    input_window_s: float = 5.0
    stride_s: float = 0.5
    stopped_speed: float = 0.5
    turn_deg: float = 10.0
    blinker_steer_deg: float = 5.0
    accel: float = 0.37
    brake: float = -0.35
    lead_dist_m: float = 60.0
    follow_accel: float = 1.0
    negative_stride_s: float = 2.0
    negative_buffer_s: float = 2.0
    cap_factor: int = 15
    cap_max: int = 1000
    min_rows: int = 10
    adas_dominant: float = 0.7
    human_only: float = 0.1
    gps_hacc_m: float = 50.0
    gps_jump_deg: float = 0.005
    gps_quality_jump_deg: float = 0.001
    turn_lookahead_deg: float = 30.0
    intersection_degree: int = 3
    intersection_horizon_m: float = 300.0
    reach_m: float = 200.0
    near_intersection_m: float = 50.0
    max_weight: float = 10.0


#: Classes in index order, and in the order in which a text is searched for them.
CLASSES = ("Accelerating", "Braking", "CarFollowing", "Cruising", "LaneChange", "Stopped", "Turning")
PARSE_ORDER = ("Stopped", "Cruising", "CarFollowing", "Accelerating", "Braking", "LaneChange", "Turning")

#: Columns of the signal streams.
MODALITIES = {
    "vehicle_dynamics": ("vEgo", "aEgo", "steeringAngleDeg", "steeringTorque", "steeringPressed", "gas", "gasPressed", "brake", "brakePressed", "cruiseState_enabled", "cc_latActive", "leftBlinker", "rightBlinker", "actuators_accel", "cs_longControlState"),
    "planning": ("model_desiredCurvature", "model_desiredAcceleration", "laneLeft_prob", "laneRight_prob", "laneLeft_y", "laneRight_y", "laneChangeState", "hasLead"),
    "radar": ("leadOne_status", "leadOne_dRel", "leadOne_vRel", "leadOne_aRel", "leadOne_yRel", "leadOne_vLead", "leadTwo_status", "leadTwo_dRel", "leadTwo_vRel", "leadTwo_aRel", "leadTwo_yRel", "leadTwo_vLead"),
    "driver_state": ("face_yaw", "face_pitch", "face_roll", "face_pos_x", "face_pos_y", "faceProb", "leftEyeProb", "rightEyeProb", "leftBlinkProb", "rightBlinkProb", "sunglassesProb", "occludedProb", "readyProb_1", "notReadyProb_1"),
    "imu": ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z"),
}
#: Defaults of missing signals, where they are not 0.
SIGNAL_DEFAULTS = {"leadOne_dRel": 999.0, "leadTwo_dRel": 999.0}
#: Columns of the GPS features.
GPS_COLUMNS = ("gps_speed_mps", "heading_deg", "heading_change_rate", "curvature", "is_stopped", "stopped_duration_s", "road_type_enc", "is_highway", "speed_limit_kph", "n_lanes", "is_on_ramp", "dist_to_intersection_m", "is_near_intersection", "road_network_density", "bearing_vs_road", "hw_dist_to_intersection_m", "hw_n_intersections_300m", "hw_is_ramp_ahead_300m")


@dataclass(frozen=True)
class Configuration:
    """What an experiment reads: signal streams, GPS features, the front and the cabin camera."""

    streams: tuple[str, ...] = ()
    gps: bool = False
    front_video: bool = False
    cabin_video: bool = False


_OUTSIDE = ("planning", "radar")
_ALL = ("vehicle_dynamics", *_OUTSIDE, "driver_state", "imu")
#: The 16 configurations.
CONFIGURATIONS = {
    "Veh": Configuration(("vehicle_dynamics",)),
    "Drv": Configuration(("driver_state",)),
    "Int": Configuration(_OUTSIDE),
    "Veh+Int": Configuration(("vehicle_dynamics", *_OUTSIDE)),
    "Veh+Int+Drv": Configuration(("vehicle_dynamics", *_OUTSIDE, "driver_state")),
    "Full-Struct": Configuration(_ALL),
    "Full-Struct+GPS": Configuration(_ALL, gps=True),
    "Full-Struct+FV": Configuration(_ALL, front_video=True),
    "Full-Struct+CV": Configuration(_ALL, cabin_video=True),
    "Full-Multimodal": Configuration(_ALL, front_video=True, cabin_video=True),
    "Full-All": Configuration(_ALL, gps=True, front_video=True, cabin_video=True),
    "Ctx": Configuration(gps=True),
    "IMU": Configuration(("imu",)),
    "FV": Configuration(front_video=True),
    "CV": Configuration(cabin_video=True),
    "FV+CV": Configuration(front_video=True, cabin_video=True),
}


def columns_of(configuration: str) -> list[str]:
    """The input columns of a configuration, stream by stream, GPS features last."""
    c = CONFIGURATIONS[configuration]
    return [x for s in c.streams for x in MODALITIES[s]] + list(GPS_COLUMNS if c.gps else ())
