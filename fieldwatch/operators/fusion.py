"""Evidence fusion of the service profile: classes, severity, cause and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, SEQUENCE_ERROR_THRESHOLD
from fieldwatch.functions import physics
from fieldwatch.functions.text import compact_texts, ladder, maintenance_action, maintenance_status

NORMAL = "NORMAL"
WEATHER = "LIKELY_GENUINE_WEATHER_EVENT"
FAULT = "LIKELY_SENSOR_DATA_FAULT"
UNCERTAIN = "UNCERTAIN"

# Texts of the decision table.
MISSING_CAUSE = "Data transmission dropout, logger power failure, or satellite uplink loss."
MISSING_ACTION = "Inspect station power supply and telemetry transmission status."
WEATHER_CAUSE = "Rapid meteorological transition (e.g. cyclonic frontal passage, katabatic wind event, or intense temperature inversion breakdown) corroborated by spatial buddy station "
WEATHER_ACTION = "Do NOT flag as sensor fault. Retain observation in climatological record. Issue mesoscale weather advisory if rate of change exceeds operational aviation thresholds."
UNCERTAIN_CAUSE = "Conflicting or insufficient evidence: Single-station anomaly detected by analytical models without decisive spatial corroboration."
UNCERTAIN_ACTION = "Mark observation for human meteorologist review. Correlate with regional satellite imagery or wait for subsequent hourly observations to verify trend continuity."
NORMAL_CAUSE = "No Significant Anomaly"
NORMAL_ACTION = "Routine continuous monitoring. No operator action required."
FAULT_ACTION = "Immediate operational action: Flag observation as invalid. Invalidate downstream NWP ingestion. Inspect "

# Names of the evidence scores, in reporting order.
SCORE_NAMES = (
    "rule_qc",
    "iforest",
    "lstm_autoencoder",
    "multivariate_consistency",
    "thermodynamic_violation",
    "spatial_evidence",
    "station_health",
)


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def iforest_evidence(score: Column) -> Column:
    """Sigmoid around the threshold 0.65; 0 without a score."""
    return F.coalesce(1.0 / (1.0 + F.exp(-10.0 * (score - 0.65))), F.lit(0.0))


def sequence_evidence(mse: Column, threshold: float = SEQUENCE_ERROR_THRESHOLD) -> Column:
    """1 - exp(-0.7 * mse / threshold); 0 without an error."""
    return F.coalesce(1.0 - F.exp(-0.7 * mse / max(threshold, 1e-6)), F.lit(0.0))


def with_text(df: DataFrame) -> DataFrame:
    """The reasons as one lower-case text, a line each: the tests below are plain text
    searches inside generated code, not lambdas over an array."""
    return df if "_text" in df.columns else df.withColumn("_text", F.lower(F.concat_ws("\n", "qc_reasons")))


def _reason_with(word: str, other: str = "") -> Column:
    """Some reason holds the word (and, on the same line, the other one)."""
    text = F.col("_text")
    return text.rlike(f"(?m)^(?=.*{other}).*{word}") if other else text.contains(word)


def qc_evidence(df: DataFrame) -> DataFrame:
    """`has_plausibility`, `has_flatline`, `has_spike` and `qc_score` from the reason texts.
    Within one reason the first matching word counts."""
    df, text = with_text(df), F.col("_text")
    return df.withColumns(
        {
            "has_plausibility": text.contains("plausibility"),
            "has_flatline": text.rlike("(?m)^(?!.*plausibility).*flatline"),
            "has_spike": text.rlike("(?m)^(?!.*(?:plausibility|flatline)).*(?:spike|rate of change)"),
        }
    ).withColumn(
        "qc_score",
        F.when(F.col("has_plausibility"), 1.0)
        .when(F.col("has_flatline"), 0.85)
        .when(F.col("has_spike"), 0.75)
        .otherwise(0.0),
    )


# Words by which a reason text names a channel.
WORDS = {"temperature": "temp", "pressure": "press", "humidity": "hum"}


def affected_parameters(df: DataFrame) -> DataFrame:
    """`affected_parameters` and `primary_parameter`."""
    df = with_text(df)
    named = {c: _reason_with(w) for c, w in WORDS.items()}
    hit = {c: named[c] | _yes(f"{c}_spike") | _yes(f"{c}_flatline") for c in CHANNELS}
    df = df.withColumn(
        "affected_parameters", compact_texts(*[F.when(hit[c], F.lit(c)) for c in CHANNELS])
    )
    first = F.when(F.size("affected_parameters") > 0, F.col("affected_parameters")[0])
    return df.withColumn(
        "primary_parameter",
        ladder([(named[c], c) for c in CHANNELS], F.coalesce(first, F.lit("multivariate"))),
    )


def physical_evidence(df: DataFrame) -> DataFrame:
    t, p, h = (F.col(c) for c in CHANNELS)
    if "dew_point" not in df.columns:
        df = df.withColumn("dew_point", physics.dew_point(t, h))
    td = F.col("dew_point")
    df = df.withColumn("thermo_score", physics.thermo_score(t, p, h, td))
    return df.withColumn("thermo_status", physics.thermo_status(t, h, F.col("thermo_score")))


def indicator_counts(df: DataFrame) -> DataFrame:
    """Fault and weather points and the number of agreeing sources."""
    known = F.coalesce(~F.col("spatial_status").isin("NO_BUDDY_DATA", "UNAVAILABLE"), F.lit(False))
    score = F.coalesce("spatial_score", F.lit(0.0))
    df = df.withColumns(
        {
            "has_spatial": known,
            "_sp": score,
            "if_evidence": iforest_evidence(F.col("iforest_score")),
            "seq_evidence": sequence_evidence(F.col("sequence_mse")),
        }
    )

    def points(cond, n):
        return F.when(cond, n).otherwise(0)

    both_models = (F.col("if_evidence") > 0.8) & (F.col("seq_evidence") > 0.8) & (F.col("_sp") <= 0.0)
    health = F.coalesce("overall_health_index", F.lit(100.0))
    fault = (
        points(F.col("has_plausibility"), 2)
        + points(F.col("thermo_score") >= 0.9, 2)
        + points(F.col("has_spatial") & (F.col("_sp") < -0.6), 1)
        + points(F.col("has_flatline"), 1)
        + points(both_models, 1)
        + points(_yes("multivariate_anomaly"), 1)
        + points(health < 50.0, 1)
    )
    spike_near = F.col("has_spatial") & F.col("has_spike")
    model = (F.col("if_evidence") > 0.5) | (F.col("seq_evidence") > 0.5)
    weather = points(spike_near & (F.col("_sp") >= 0.6) & model, 2) + points(
        spike_near & _yes("spatial_agreement"), 2
    )
    count = (
        points(F.col("qc_flag") != "PASSED", 1)
        + points(_yes("iforest_flag"), 1)
        + points(_yes("sequence_flag"), 1)
        + points(_yes("multivariate_anomaly"), 1)
    )
    df = df.withColumns({"_fault": fault, "weather_indicators": weather, "evidence_count": count})
    forced = (F.col("evidence_count") >= 3) & (F.col("weather_indicators") == 0)
    return df.withColumn(
        "fault_indicators",
        F.when(forced, F.greatest(F.col("_fault"), F.lit(2))).otherwise(F.col("_fault")),
    ).drop("_fault")


def _classify(df: DataFrame) -> DataFrame:
    gone = F.col("temperature").isNull() & F.col("pressure").isNull() & F.col("humidity").isNull()
    fault, weather = F.col("fault_indicators"), F.col("weather_indicators")
    unsure = (
        ((fault == 1) & (weather == 0))
        | ((fault > 0) & (weather > 0))
        | ((F.col("if_evidence") > 0.7) & ~F.col("has_spatial") & ~F.col("has_plausibility"))
    )
    df = df.withColumn("all_missing", gone)
    return df.withColumn(
        "classification",
        ladder(
            [
                (F.col("all_missing"), UNCERTAIN),
                (fault >= 2, FAULT),
                ((weather >= 2) & (fault == 0), WEATHER),
                (unsure, UNCERTAIN),
            ],
            NORMAL,
        ),
    )


def _severity(df: DataFrame) -> DataFrame:
    is_ = {k: F.col("classification") == k for k in (FAULT, WEATHER, UNCERTAIN)}
    critical = (
        F.col("has_plausibility")
        | (F.col("thermo_score") >= 0.9)
        | (F.col("has_spatial") & (F.col("_sp") <= -0.9))
    )
    quiet = (F.col("if_evidence") < 0.3) & (F.col("seq_evidence") < 0.3) & (F.col("qc_score") == 0.0)
    return df.withColumns(
        {
            "severity": ladder(
                [
                    (F.col("all_missing"), "HIGH"),
                    (is_[FAULT] & critical, "CRITICAL"),
                    (is_[FAULT] & ((F.col("evidence_count") >= 3) | F.col("has_flatline")), "HIGH"),
                    (is_[FAULT] | is_[WEATHER], "MEDIUM"),
                    (is_[UNCERTAIN], "LOW"),
                ],
                "NONE",
            ),
            "confidence": F.when(is_[UNCERTAIN], F.lit(None).cast("double"))
            .when(is_[FAULT], F.least(F.lit(0.99), 0.70 + (F.col("fault_indicators") - 2) * 0.10))
            .when(is_[WEATHER], F.least(F.lit(0.95), 0.75 + (F.col("weather_indicators") - 2) * 0.10))
            .when(quiet, 0.98)
            .otherwise(0.85),
        }
    )


def _cause_and_action(df: DataFrame) -> DataFrame:
    plaus = [
        (_reason_with(WORDS[c], "plausibility"), f"{c.capitalize()} Plausibility Violation")
        for c in ("pressure", "temperature", "humidity")
    ]
    rapid = [(_yes(f"{c}_spike"), f"Rapid {c.capitalize()} Change") for c in CHANNELS]
    primary = F.col("primary_parameter")
    consensus = F.concat(
        F.lit("Corroborated sensor failure indicated by multi-model analytical consensus on "), primary, F.lit(".")
    )
    flat = F.concat(F.lit("Sensor freezing or mechanical flatline detected on "), primary, F.lit("."))
    buddy = F.col("buddy_station_id")
    kind = F.col("classification")
    near = F.col("has_spatial") & buddy.isNotNull()
    df = df.withColumns(
        {
            "probable_cause": ladder(
                [
                    (F.col("all_missing"), MISSING_CAUSE),
                    (kind == FAULT, ladder([*plaus, *rapid, (F.col("has_flatline"), flat)], consensus)),
                    (
                        kind == WEATHER,
                        F.concat(F.lit(WEATHER_CAUSE), F.coalesce(buddy, F.lit("network")), F.lit(".")),
                    ),
                    (kind == UNCERTAIN, ladder(plaus, UNCERTAIN_CAUSE)),
                ],
                NORMAL_CAUSE,
            ),
            "operator_action": ladder(
                [
                    (F.col("all_missing"), MISSING_ACTION),
                    (
                        (kind == FAULT) & near,
                        F.concat(F.lit(FAULT_ACTION), primary, F.lit(" transducer and compare with buddy station "), buddy, F.lit(".")),
                    ),
                    (
                        kind == FAULT,
                        F.concat(F.lit(FAULT_ACTION), primary, F.lit(" transducer, signal cable, and A/D converter.")),
                    ),
                    (kind == WEATHER, WEATHER_ACTION),
                    (kind == UNCERTAIN, UNCERTAIN_ACTION),
                ],
                NORMAL_ACTION,
            ),
        }
    )
    return df.withColumns(
        {
            "maintenance_status": maintenance_status(F.col("severity"), kind),
            "maintenance_action": maintenance_action(F.col("probable_cause"), F.col("operator_action")),
            "primary_parameter": F.when(F.col("all_missing"), "all").when(kind != NORMAL, primary),
            "affected_parameters": F.when(
                F.col("all_missing") | (kind == NORMAL), F.array().cast("array<string>")
            ).otherwise(F.col("affected_parameters")),
        }
    )


def _evidence(df: DataFrame) -> DataFrame:
    """The ordered evidence list and the named scores."""

    def item(pillar, status, score, detail):
        return F.struct(
            F.lit(pillar).alias("pillar"),
            status.cast("string").alias("status"),
            score.cast("double").alias("score"),
            detail.cast("string").alias("detail"),
        )

    t, p, h, td = F.col("temperature"), F.col("pressure"), F.col("humidity"), F.col("dew_point")
    why = physics.thermo_explanation(t, h, td, physics.thermo_violations(t, p, h, td))
    none = F.lit(None)
    items = F.array_compact(
        F.array(
            F.when(
                F.size("qc_reasons") > 0,
                item("RULE_BASED_QC", F.col("qc_flag"), F.col("qc_score"), F.concat_ws("; ", "qc_reasons")),
            ),
            F.when(
                _yes("iforest_flag") | (F.col("if_evidence") > 0.6),
                item("ISOLATION_FOREST", F.col("iforest_flag"), F.col("if_evidence"), F.col("iforest_score")),
            ),
            F.when(
                _yes("sequence_flag") | (F.col("seq_evidence") > 0.6),
                item("LSTM_AUTOENCODER", F.col("sequence_flag"), F.col("seq_evidence"), F.col("sequence_mse")),
            ),
            F.when(
                _yes("multivariate_anomaly"),
                item("MULTIVARIATE_CONSISTENCY", F.lit(True), F.col("multivariate_score"), none),
            ),
            F.when(
                F.col("thermo_status") != "UNAVAILABLE",
                item("THERMODYNAMICS", F.col("thermo_status"), F.col("thermo_score"), why),
            ),
            F.when(
                F.col("has_spatial"),
                item("SPATIAL_CROSS_VALIDATION", F.col("spatial_status"), F.col("_sp"), F.col("buddy_station_id")),
            ).otherwise(
                item(
                    "SPATIAL_CROSS_VALIDATION",
                    F.lit("UNAVAILABLE"),
                    F.lit(0.0),
                    F.lit("Single-station operation: No neighboring AWS observation provided."),
                )
            ),
            F.when(
                F.col("overall_status") != "OPERATIONAL",
                item("SENSOR_HISTORY", F.col("overall_status"), F.col("overall_health_index"), F.concat_ws("; ", "active_alerts")),
            ),
        )
    )
    lost = F.array(item("DATA_INTEGRITY", none, none, F.lit("All meteorological parameters are missing")))
    values = (
        F.col("qc_score"),
        F.col("if_evidence"),
        F.col("seq_evidence"),
        F.when(_yes("multivariate_anomaly"), 1.0).otherwise(0.0),
        F.col("thermo_score"),
        F.col("_sp"),
        F.coalesce("overall_health_index", F.lit(100.0)) / 100.0,
    )
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n in SCORE_NAMES]), F.array(*values))
    return df.withColumns(
        {
            "evidence": F.when(F.col("all_missing"), lost)
            .when(F.col("classification") == NORMAL, F.filter(items, lambda x: F.lit(False)))
            .otherwise(items),
            "evidence_scores": F.when(
                F.col("all_missing"), F.create_map(F.lit("completeness"), F.lit(0.0))
            ).otherwise(scores),
        }
    )


def fuse(df: DataFrame) -> DataFrame:
    """The full decision per row.

    Input: values, the QC result, `iforest_score/flag`, `sequence_mse/flag`,
    `multivariate_anomaly/score`, `spatial_status/score/agreement`, `buddy_station_id`,
    `overall_health_index/status`, `active_alerts`; null where a source is not available.
    Column expressions only: no shuffle.
    """
    df = physical_evidence(affected_parameters(qc_evidence(df)))
    return _evidence(_cause_and_action(_severity(_classify(indicator_counts(df)))))


def evidence_count_5(df: DataFrame) -> DataFrame:
    """Agreeing pillars out of five.  The spatial one tests a status the spatial check never
    gives (FLAGGED); kept as found."""
    physical = (F.col("thermo_status") == "FLAGGED") | _yes("multivariate_anomaly")
    flags = [
        F.col("qc_flag") != "PASSED",
        _yes("iforest_flag"),
        _yes("sequence_flag"),
        physical,
        F.coalesce(F.col("spatial_status") == "FLAGGED", F.lit(False)),
    ]
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return df.withColumns({"evidence_count_5": total, "evidence_total": F.lit(5)})


def pillar_agreement(df: DataFrame) -> DataFrame:
    """FLAGGED / CLEAR / UNAVAILABLE per pillar, and the agreement over the four core ones."""

    def state(flag, available=None):
        out = F.when(F.coalesce(flag, F.lit(False)), "FLAGGED")
        if available is not None:
            out = out.when(~available, "UNAVAILABLE")
        return out.otherwise("CLEAR")

    core = {
        "qc_pillar": state(F.col("qc_flag") != "PASSED"),
        "iforest_pillar": state(F.col("iforest_flag"), F.col("iforest_flag").isNotNull()),
        "sequence_pillar": state(F.col("sequence_flag"), F.col("sequence_mse").isNotNull()),
        "physical_pillar": state((F.col("thermo_status") == "FLAGGED") | _yes("multivariate_anomaly")),
    }
    spatial = F.col("spatial_status")
    known = F.coalesce(~spatial.isin("UNAVAILABLE", "NOT_APPLICABLE"), F.lit(False))
    out = df.withColumns({**core, "spatial_pillar": state(spatial == "FLAGGED", known)})
    hits = F.lit(0)
    for name in core:
        hits = hits + (F.col(name) == "FLAGGED").cast("int")
    return out.withColumn("agreement_pct", F.round(hits / 4 * 100).cast("int"))


def decision_row(df: DataFrame) -> DataFrame:
    """The wide output row of a fused observation, with the nested parts also as JSON text."""
    df = with_text(evidence_count_5(df))
    by = {
        "range_flags": [_reason_with(f"{c}_plausibility") for c in CHANNELS],
        "rate_flags": [F.col(f"{c}_spike") for c in CHANNELS],
        "flatline_flags": [F.col(f"{c}_flatline") for c in CHANNELS],
    }
    maps = {
        k: F.map_from_arrays(F.array(*[F.lit(c) for c in CHANNELS]), F.array(*v)) for k, v in by.items()
    }

    def model(flag):
        return F.when(F.col(flag), "FLAGGED").when(~F.col(flag), "CLEAR").otherwise("UNAVAILABLE")

    out = df.select(
        "station_id",
        "timestamp",
        *CHANNELS,
        F.round("dew_point", 2).alias("dew_point"),
        "qc_flag",
        "qc_reasons",
        *[v.alias(k) for k, v in maps.items()],
        "gap_flag",
        F.round("iforest_score", 4).alias("iforest_score"),
        model("iforest_flag").alias("iforest_status"),
        F.round("sequence_mse", 6).alias("sequence_mse"),
        model("sequence_flag").alias("sequence_status"),
        _yes("multivariate_anomaly").alias("multivariate_anomaly"),
        F.round("multivariate_score", 4).alias("multivariate_score"),
        "thermo_status",
        "spatial_status",
        "spatial_score",
        F.col("evidence_count_5").alias("evidence_count"),
        "evidence_total",
        "classification",
        "severity",
        F.round("confidence", 4).alias("confidence"),
        "primary_parameter",
        "affected_parameters",
        "probable_cause",
        "operator_action",
        "maintenance_status",
        "maintenance_action",
        "evidence",
        F.transform_values("evidence_scores", lambda k, v: F.round(v, 4)).alias("evidence_scores"),
    )
    payload = [c for c in out.columns if c not in ("station_id", "timestamp")]
    return out.withColumn("payload_json", F.to_json(F.struct("station_id", "timestamp", *payload)))
