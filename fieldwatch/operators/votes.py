"""Vote-count fusion of the hourly profile, with texts and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, SPIKE_LIMIT
from fieldwatch.functions.text import joined, ladder
from fieldwatch.timeline import Timeline

# Class names and reason texts.
NORMAL, FAULT, UNCERTAIN = "Normal", "Likely Sensor/Data Fault", "Uncertain"
NAMES = {"temperature": "Temperature", "pressure": "Atmospheric Pressure", "humidity": "Relative Humidity"}
SHORT_NAMES = {"temperature": "Temperature", "pressure": "Pressure", "humidity": "Humidity"}
BATCH_TEXTS = (
    ("qc_flag", "Rule-based quality checks flagged the observation"),
    ("if_anomaly", "Isolation Forest detected an unusual multivariate pattern"),
    ("sequence_anomaly", "LSTM detected an abnormal temporal pattern"),
    ("multivariate_anomaly", "Temperature, pressure and humidity changes were inconsistent"),
)
EVENT_TEXTS = (
    ("qc_flag", "Rule-based quality checks flagged the observation"),
    ("if_anomaly", "Isolation Forest detected an unusual pattern"),
    ("sequence_anomaly", "LSTM detected abnormal temporal behavior"),
    ("multivariate_anomaly", "Temperature, pressure and humidity showed unusual joint behavior"),
    ("isolated_event", "Temperature showed an isolated jump/recovery pattern"),
)
NO_SPATIAL = "Spatial validation unavailable for the single-station dataset"
GAP_CAUSE = "Communication/Data Gap"
NO_CAUSE = "No Significant Anomaly"


def _yes(df: DataFrame, name: str) -> Column:
    """A boolean column; false where missing or absent."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _count(flags) -> Column:
    out = F.lit(0)
    for f in flags:
        out = out + f.cast("int")
    return out


def isolated_event(df: DataFrame, limit: float = SPIKE_LIMIT) -> DataFrame:
    """Temperature away from both neighbouring rows."""
    tl = Timeline(df, lookahead=1)
    t = F.col("temperature")
    both = (F.abs(t - tl.lag("temperature")) > limit) & (F.abs(t - tl.lead("temperature")) > limit)
    return tl.done(tl.df.withColumn("isolated_event", F.coalesce(both, F.lit(False))))


def vote(df: DataFrame) -> DataFrame:
    """`evidence_count` of the four detectors, `final_anomaly` (two or more) and the class."""
    n = _count(_yes(df, c) for c, _ in BATCH_TEXTS)
    df = df.withColumn("evidence_count", n)
    count = F.col("evidence_count")
    return df.withColumns(
        {
            "final_anomaly": count >= 2,
            "final_classification": ladder([(count == 0, NORMAL), (count >= 3, FAULT)], UNCERTAIN),
        }
    )


def vote_isolated(df: DataFrame) -> DataFrame:
    """The class of the event study: a fault needs two votes, an inconsistent joint change and
    an isolated event."""
    count = _count(_yes(df, c) for c, _ in BATCH_TEXTS)
    fault = (count >= 2) & _yes(df, "multivariate_anomaly") & _yes(df, "isolated_event")
    return df.withColumn("signal_count", count).withColumn(
        "final_classification", ladder([(count == 0, NORMAL), (fault, FAULT)], UNCERTAIN)
    )


def explain(df: DataFrame) -> DataFrame:
    parts = [(_yes(df, c), t) for c, t in BATCH_TEXTS]
    return df.withColumn("explanation", joined(parts, "No significant anomaly evidence detected"))


def explain_event(df: DataFrame, spatial: str = "spatial_available") -> DataFrame:
    """The event study's sentences and its primary reason."""
    parts = [(_yes(df, c), t) for c, t in EVENT_TEXTS] + [(~_yes(df, spatial), NO_SPATIAL)]
    qc, forest, seq, joint, alone = (_yes(df, c) for c, _ in EVENT_TEXTS)
    return df.withColumns(
        {
            "explanation": joined(parts, "No significant anomaly evidence"),
            "primary_reason": ladder(
                [
                    (forest & seq & joint & alone, "Multiple detectors agree with an isolated temperature jump/recovery"),
                    (joint & alone, "Unusual T/P/RH behavior with an isolated temperature event"),
                    (seq & forest, "Temporal and statistical models detected abnormal behavior"),
                    (qc, "Rule-based quality checks detected suspicious behavior"),
                ],
                "No strong anomaly evidence",
            ),
        }
    )


def attribute_parameters(df: DataFrame) -> DataFrame:
    """`<channel>_anomaly`: any of the channel's own flags; and the list text."""
    hit = {}
    for c in CHANNELS:
        flag = F.lit(False)
        for kind in ("range", "rate", "spike", "flatline"):
            flag = flag | _yes(df, f"{c}_{kind}_flag")
        hit[c] = flag
    text = joined([(hit[c], NAMES[c]) for c in CHANNELS], "None", ", ")
    return df.withColumns({**{f"{c}_anomaly": f for c, f in hit.items()}, "affected_parameters": text})


def _causes(df: DataFrame, spikes, models) -> Column:
    parts = [(_yes(df, "gap_flag"), GAP_CAUSE)]
    parts += [(_yes(df, f"{c}_range_flag"), f"{SHORT_NAMES[c]} Range Violation") for c in CHANNELS]
    parts += [(_yes(df, f"{c}_rate_flag"), f"Rapid {SHORT_NAMES[c]} Change") for c in CHANNELS]
    parts += [(_yes(df, f"{c}_spike_flag"), f"{SHORT_NAMES[c]} Spike") for c in spikes]
    parts += [(_yes(df, f"{c}_flatline_flag"), f"{SHORT_NAMES[c]} Sensor Flatline") for c in CHANNELS]
    return joined(parts + [(_yes(df, c), t) for c, t in models], NO_CAUSE)


def assess(df: DataFrame) -> DataFrame:
    """Agreement percentage, root-cause list, severity, maintenance, decision, recovery text."""
    count = F.col("evidence_count")
    out_of_range = F.lit(False)
    for c in CHANNELS:
        out_of_range = out_of_range | _yes(df, f"{c}_range_flag")
    models = (
        ("if_anomaly", "Unusual Multivariate Pattern"),
        ("sequence_anomaly", "Abnormal Temporal Pattern"),
        ("multivariate_anomaly", "T/P/RH Inconsistency"),
    )
    df = df.withColumns(
        {
            "evidence_confidence": F.round(count / 4 * 100, 1),
            "root_cause": _causes(df, CHANNELS, models),
            "severity": ladder(
                [
                    ((count >= 4) | out_of_range, "Critical"),
                    (count >= 3, "High"),
                    (count == 2, "Medium"),
                    (count == 1, "Low"),
                ],
                "Normal",
            ),
        }
    )
    severity, kind = F.col("severity"), F.col("final_classification")
    available = _yes(df, "recovery_available")
    names = F.col("recovery_parameters") if "recovery_parameters" in df.columns else F.lit("Unknown")
    return df.withColumns(
        {
            "maintenance_status": ladder(
                [
                    (severity.isin("Critical", "High"), "Inspection Recommended"),
                    (severity == "Medium", "Monitor Closely"),
                    (severity == "Low", "Monitor"),
                ],
                "Normal",
            ),
            "operational_decision": ladder(
                [
                    ((kind == FAULT) & (severity == "Critical"), "Immediate Sensor Inspection"),
                    ((kind == FAULT) & (severity == "High"), "Sensor Inspection Recommended"),
                    (kind == FAULT, "Review Sensor/Data Quality"),
                    (kind == UNCERTAIN, "Monitor Observation"),
                ],
                "No Action Required",
            ),
            "recovery_status": F.when(
                available, F.concat(F.lit("Estimated values available for: "), names)
            ).otherwise("No recovery estimate available"),
        }
    )


def primary_root_cause(df: DataFrame) -> DataFrame:
    """The list of contributing causes, and one cause by priority."""
    models = (
        ("multivariate_anomaly", "Multivariate T/P/RH Inconsistency"),
        ("sequence_anomaly", "Abnormal Temporal Pattern"),
        ("if_anomaly", "Unusual Multivariate Pattern"),
    )

    def family(kind, many, one):
        flags = {c: _yes(df, f"{c}_{kind}_flag") for c in CHANNELS}
        n = _count(flags.values())
        return [(n > 1, many), *[(f, one.format(NAMES[c])) for c, f in flags.items()]]

    rules = [
        (_yes(df, "gap_flag"), GAP_CAUSE),
        *family("range", "Multiple Parameter Range Violations", "{} Range Violation"),
        *family("rate", "Multiple Parameter Rapid Changes", "Rapid {} Change"),
        (_yes(df, "temperature_spike_flag"), "Temperature Spike"),
        *family("flatline", "Multiple Sensor Flatlines", "{} Sensor Flatline"),
        *[(_yes(df, c), t) for c, t in models],
    ]
    return df.withColumns(
        {
            "contributing_causes": _causes(df, ("temperature",), models),
            "primary_root_cause": ladder(rules, NO_CAUSE),
        }
    )
