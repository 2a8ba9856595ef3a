"""Explainable scores: sums of rule weights and ladders of bands, each with its own table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weight and the reason of each rule, in the order in which reasons are listed.
RULES = {
    "restricted_intrusion": (35, "Restricted Zone Intrusion"),
    "tripwire_breach": (30, "Directional Tripwire Breach"),
    "weapon_observation": (35, "Weapon-like Object Detected"),
    "persistence": (20, "Persistent Long-Dwell Presence"),
    "repeated_entry": (15, "Repeated Zone Re-entry"),
    "loitering": (15, "Loitering Beyond Threshold"),
    "night_movement": (15, "Night Movement (22:00-05:00 / Low Light)"),
    "towards_protected": (15, "Perimeter Closing Velocity / Movement Vector Toward Protected Area"),
    "coordinated_movement": (15, "Coordinated Target Movement Vector"),
    "rapid_influx": (10, "Rapid Target Influx Rate"),
    "multiple_unauthorized": (10, "Multiple Unauthorized Tracks in Sector"),
    "cross_camera": (5, "Cross-Camera Continuity Detected"),
}
NOMINAL = "Standard autonomous perimeter surveillance (Nominal)"
#: The least score of each level, by ladder.
THREAT_LEVELS = [(65, "CRITICAL"), (50, "HIGH"), (30, "RESTRICTED")]
INCIDENT_SEVERITIES = [(85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (30, "LOW")]
ALERT_SEVERITIES = [(85, "CRITICAL"), (70, "HIGH")]
SECTOR_LEVELS = [(60, "CRITICAL"), (25, "RESTRICTED")]
PROFILE_LEVELS = [(85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (30, "LOW")]
COVERAGE_GRADES = [(90, "GRADE_A_COMBAT_READY"), (70, "GRADE_B_DEGRADED")]
LEAST_COVERAGE = "GRADE_C_VULNERABLE"
#: What a zone's severity may be called, and the kinds of zones.
ZONE_SEVERITIES = {"critical": ["critical", "high"], "restricted": ["restricted", "warning", "medium"]}
ZONE_TYPES = ["normal", "restricted", "sensitive", "critical", "entry", "exit"]


def band(score: Column, ladder: list[tuple[float, str]], otherwise: Column | str) -> Column:
    """The first level of a ladder that the score reaches."""
    found = reduce(lambda c, step: c.when(score >= step[0], step[1]), ladder[1:], F.when(score >= ladder[0][0], ladder[0][1]))
    return found.otherwise(otherwise)


def threat(flags: dict[str, Column]) -> Column:
    """Score 0 to 100, level and reasons, of boolean columns named as in RULES; null counts as false."""
    known = [(name, F.coalesce(flags[name], F.lit(False))) for name in RULES if name in flags]
    total = reduce(lambda a, b: a + b, (F.when(flag, RULES[name][0]).otherwise(0) for name, flag in known), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double")))
    reasons = F.array_compact(F.array(*(F.when(flag, f"+{RULES[name][0]} {RULES[name][1]}") for name, flag in known)))
    level = band(score, THREAT_LEVELS, F.when(score > 0, "LOW").otherwise("NORMAL"))
    return F.struct(score.alias("score"), level.alias("level"), F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(NOMINAL))).alias("reasons"))


def sector_index(tripwires: Column, restricted: Column, loitering: Column, tracks: Column, live_base: Column | float = 0.0) -> Column:
    """A sector's index: 35 for each tripwire, 30 restricted, 20 loitering event, 15 for several tracks, within 100."""
    total = 35 * tripwires + 30 * restricted + 20 * loitering + F.when(tracks > 1, 15).otherwise(0) + live_base
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double")))


def sector_score(critical: Column, restricted: Column, loitering: Column, tracks: Column, flags: dict[str, Column], live: Column | None = None, fast: Column | None = None) -> Column:
    """A sector's score 0 to 100 and level, from its counted alerts, live tracks and signs.

    ``flags``: night (counts with live tracks only), protected, coordinated, influx, and intrusion, which with several
    tracks counts as unauthorised company. One live track gives 25, more 35, and 15 if any is fast.
    """
    live = F.lit(0) if live is None else live
    base = F.when(live == 1, 25.0).when(live >= 2, 35.0).otherwise(0.0) + F.when(F.coalesce(fast, F.lit(False)) if fast is not None else F.lit(False), 15.0).otherwise(0.0)
    worth = lambda name, points, also=None: F.when(flags.get(name, F.lit(False)) & (also if also is not None else F.lit(True)), float(points)).otherwise(0.0)
    total = base + 35.0 * critical + 30.0 * restricted + 20.0 * loitering + worth("night", 15, live > 0) + worth("protected", 15) + worth("coordinated", 15) + worth("influx", 10) + worth("intrusion", 10, tracks > 1)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
    return F.struct(total.alias("raw"), score.alias("score"), band(score, SECTOR_LEVELS, "NORMAL").alias("level"))


def incident_severity(score: Column) -> Column:
    return band(score, INCIDENT_SEVERITIES, "INFO")


def raises_alert(score: Column, text: Column) -> Column:
    """Whether a new incident raises an alert: by score, or by its words."""
    return (score >= 30) | F.lower(F.coalesce(text, F.lit(""))).rlike("intrusion|breach|weapon")


def transition_plausibility(same: Column, linked: Column, configured: Column, elapsed: Column, least: Column, most: Column, mean: Column, weight: Column) -> Column:
    """Whether a walk between two cameras is plausible, and how much; link columns are null where there is none."""
    in_time = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.5), 1 - F.abs(elapsed - mean) / (most + 1e-6)) * weight), 2)
    score = (
        F.when(same, 1.0)
        .when(~linked & configured, F.when(elapsed > 300, 0.25).otherwise(0.05))
        .when(~linked, 0.70)
        .when(elapsed < least * 0.5, 0.1)
        .when(elapsed > most * 2, 0.4)
        .otherwise(in_time)
    )
    rejected = ~same & ((~linked & configured & (elapsed <= 300)) | (linked & (elapsed < least * 0.5)))
    return F.struct((~F.coalesce(rejected, F.lit(False))).alias("plausible"), score.alias("score"))


def correlation_confidence(delta: Column, expected: Column, window: Column, horizon: float = 60.0) -> Column:
    """Confidence that an exit and an entry are one person's; ``expected`` and ``window`` are null without a link."""
    linked = F.greatest(F.lit(0.55), F.least(F.lit(0.92), 1 - F.abs(delta - expected) / window))
    return F.when(expected.isNotNull(), linked).otherwise(F.greatest(F.lit(0.40), F.least(F.lit(0.75), 1 - delta / horizon)))


def frame_quality(confidence: Column, sharpness: Column, size: Column) -> Column:
    return 0.45 * confidence + 0.35 * sharpness + 0.20 * size


def optical_status(frozen: Column, glare: Column, dark: Column, mean: Column, blur: Column) -> Column:
    """A camera's optical state, the worst first."""
    return F.when(frozen, "FROZEN").when(glare >= 35, "GLARE").when((dark >= 75) & (mean < 20), "DARK").when(blur < 30, "BLURRED").otherwise("CLEAR")


def is_night(ts: Column, brightness: Column | None = None) -> Column:
    """From 22 to 5 o'clock by the event's own time, or in the dark."""
    late = (F.hour(ts) >= 22) | (F.hour(ts) < 5)
    return late if brightness is None else late | F.coalesce(brightness < 35, F.lit(False))


def zone_severity(name: Column) -> Column:
    """critical, restricted or normal, of a severity by any of its names; an unknown or null one is normal."""
    low = F.lower(F.trim(name))
    return reduce(lambda c, s: c.when(low.isin(s[1]), s[0]), ZONE_SEVERITIES.items(), F.when(F.lit(False), "")).otherwise("normal")


def zone_type(name: Column) -> Column:
    """A known kind of zone; an unknown or null one is normal."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(ZONE_TYPES), low).otherwise("normal")


def coverage_grade(active: Column, total: Column) -> Column:
    """Percent of cameras that are active, to a tenth, and the grade of it; without cameras 0."""
    percent = F.round(active / F.greatest(total, F.lit(1)) * 100.0, 1)
    return F.struct(percent.alias("percent"), band(percent, COVERAGE_GRADES, LEAST_COVERAGE).alias("grade"))
