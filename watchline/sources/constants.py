"""Fixed tables: zone templates, operating profiles, kinds of sensors."""

from __future__ import annotations

# Fixed values.
SENSORS = ["RADAR", "SEISMIC", "THERMAL_IR", "RF_DETECTOR"]
ZONE_TEMPLATES = {
    "BORDER_RESTRICTED_STRIP": {"severity": "restricted", "loitering_s": 1.5, "points": [(50.0, 450.0), (1230.0, 450.0), (1230.0, 700.0), (50.0, 700.0)]},
    "GATE_ACCESS_FUNNEL": {"severity": "warning", "loitering_s": 3.0, "points": [(400.0, 100.0), (880.0, 100.0), (750.0, 650.0), (530.0, 650.0)]},
    "CRITICAL_INFRASTRUCTURE_BOX": {"severity": "critical", "loitering_s": 0.5, "points": [(200.0, 150.0), (550.0, 150.0), (550.0, 450.0), (200.0, 450.0)]},
    "VIRTUAL_PERIMETER_FENCE": {"severity": "critical", "loitering_s": None, "points": [(100.0, 400.0), (1180.0, 400.0)]},
}
PROFILES = {
    "STANDARD_DAY": {"confidence": 0.25, "iou": 0.45, "stride": 2, "loitering_s": 2.0, "optical_mode": "DAY_COLOR"},
    "HIGH_SENSITIVITY_NIGHT": {"confidence": 0.15, "iou": 0.35, "stride": 1, "loitering_s": 1.0, "optical_mode": "NIGHT_ENHANCED"},
    "ADVERSE_WEATHER_STORM": {"confidence": 0.32, "iou": 0.50, "stride": 2, "loitering_s": 3.0, "optical_mode": "STORM_FILTERED"},
    "HIGH_TRAFFIC_CONVOY": {"confidence": 0.25, "iou": 0.50, "stride": 3, "loitering_s": 4.0, "optical_mode": "DAY_COLOR"},
}
