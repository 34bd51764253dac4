"""Confidence, severity and action of an anomaly."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank, lowest first.
SEVERITIES = ["info", "warning", "error", "critical"]
# Anomaly and action names.
ANOMALY_TYPES = ["price_spike", "volume_surge", "logic_error", "sequence_gap"]
ACTIONS = ["none", "logged", "alerted", "quarantined", "rejected"]
# The ratios confidence is measured against, whatever threshold detection used.
SPIKE_THRESHOLD, SURGE_THRESHOLD = 5.0, 10.0
# Worst severity to action.
SEVERITY_ACTIONS = {"critical": "rejected", "error": "quarantined", "warning": "alerted"}


def _ramp(value: Column, threshold: float, base: float, slope: float) -> Column:
    excess = (value - threshold) / F.lit(threshold)
    return F.when(value <= threshold, F.lit(0.0)).when(
        value > threshold, F.least(F.lit(base) + excess * slope, F.lit(1.0)))


def spike_confidence(ratio: Column) -> Column:
    return _ramp(ratio, SPIKE_THRESHOLD, 0.5, 0.1)


def surge_confidence(ratio: Column) -> Column:
    return _ramp(ratio, SURGE_THRESHOLD, 0.6, 0.08)


def sequence_confidence(gap_seconds: Column, tolerance_seconds) -> Column:
    """Share of the tolerance that is used up, held within [0, 1]."""
    share = gap_seconds / F.lit(float(tolerance_seconds))
    return F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))


def severity_of(kind: Column, value: Column, threshold: Column, confidence: Column) -> Column:
    multiple = F.when(threshold != 0, value / threshold)

    def cross_candle(critical_multiple):
        return (
            F.when((confidence >= 0.9) & (multiple > critical_multiple), "critical")
            .when(confidence >= 0.7, "error").otherwise("warning")
        )

    return (
        F.when(kind == "logic_error", "error")
        .when(kind == "price_spike", cross_candle(2.0))
        .when(kind == "volume_surge", cross_candle(5.0))
        .when(kind == "sequence_gap", F.when(confidence >= 0.8, "error").otherwise("warning"))
        .otherwise("info")
    )


def severity_rank(severity: Column) -> Column:
    """0 for info up to 3 for critical; -1 for anything else."""
    out = F.lit(-1)
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def worst_severity(severities: Column) -> Column:
    """Highest severity in an array; ``info`` when it is empty."""
    rank = F.array_max(F.transform(severities, severity_rank))
    return severity_name(F.greatest(F.coalesce(rank, F.lit(0)), F.lit(0)))


def at_least(severity: Column, level: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(level)


def recommend_action(severity: Column, anomaly_count: Column, actions=None) -> Column:
    """Action for a result; ``actions`` overrides the severity map."""
    out = F.when(anomaly_count > 0, "logged").otherwise("none")
    for name, action in (actions or SEVERITY_ACTIONS).items():
        out = F.when(severity == name, action).otherwise(out)
    return out


def requires_escalation(severity: Column, anomalies: Column) -> Column:
    return at_least(severity, "error") | F.exists(anomalies, lambda a: a["confidence"] >= 0.8)


def is_acceptable(severity: Column, anomalies: Column) -> Column:
    return ~at_least(severity, "error") & ~F.exists(anomalies, lambda a: a["confidence"] >= 0.9)
