"""Moisture physics (Magnus form) as column expressions; units degC, hPa, percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwatch.functions.text import compact_texts

# Magnus coefficients over water (T >= 0) and over ice (T < 0).
E0 = 6.112
WATER = (17.67, 243.5)
ICE = (21.875, 265.5)


def saturation_vapor_pressure(t: Column) -> Column:
    def form(a, b):
        return F.lit(E0) * F.exp(F.lit(a) * t / (t + b))

    return F.when(t >= 0, form(*WATER)).when(t < 0, form(*ICE))


def actual_vapor_pressure(t: Column, rh: Column) -> Column:
    return saturation_vapor_pressure(t) * (rh / 100.0)


def dew_point(t: Column, rh: Column) -> Column:
    """Dew (frost) point; humidity is clipped to [1e-4, 100].  Null if an input is null."""
    clipped = F.when(rh > 100.0, 100.0).when(rh < 1e-4, 1e-4).otherwise(rh)
    e = saturation_vapor_pressure(t) * (clipped / 100.0)
    x = F.ln(F.when(e < 1e-6, 1e-6).otherwise(e) / E0)

    def inverse(a, b):
        return F.lit(b) * x / (F.lit(a) - x)

    return F.when(t >= 0, inverse(*WATER)).when(t < 0, inverse(*ICE))


def dew_point_spread(t: Column, rh: Column) -> Column:
    return t - dew_point(t, rh)


def dew_validity(t: Column, td: Column) -> Column:
    """Label of a dew point against the air temperature."""
    return F.when(td > t, "DEW_POINT_SUPERSATURATED").otherwise("VALID")


def thermo_violations(t: Column, p: Column, rh: Column, td: Column) -> Column:
    """Ordered texts of the physical laws an observation breaks."""
    return compact_texts(
        F.when(
            rh > 105.0,
            F.format_string(
                "Physical impossibility: Relative humidity (%.1f%%) exceeds saturation limit (105%%)",
                rh,
            ),
        ).when(
            rh < 0.0,
            F.format_string("Physical impossibility: Negative relative humidity (%.1f%%)", rh),
        ),
        F.when(
            t - td < -0.5,
            F.format_string(
                "Thermodynamic violation: Dew point (%.1f°C) exceeds ambient temperature (%.1f°C)",
                td,
                t,
            ),
        ),
        F.when(
            (t > 60.0) | (t < -100.0),
            F.format_string(
                "Physical impossibility: Temperature (%.1f°C) outside terrestrial range limits", t
            ),
        ),
        F.when(
            (p < 300.0) | (p > 1100.0),
            F.format_string(
                "Physical impossibility: Pressure (%.1f hPa) outside surface barometric limits", p
            ),
        ),
    )


def thermo_score(t: Column, p: Column, rh: Column, td: Column) -> Column:
    hard = (rh > 105.0) | (rh < 0.0) | (t > 60.0) | (t < -100.0)
    hard = hard | F.coalesce((p < 300.0) | (p > 1100.0), F.lit(False))
    return (
        F.when(t.isNull() | rh.isNull(), 0.0)
        .when(hard, 1.0)
        .when(t - td < -0.5, 0.9)
        .otherwise(0.0)
    )


def thermo_status(t: Column, rh: Column, score: Column) -> Column:
    return (
        F.when(t.isNull() | rh.isNull(), "UNAVAILABLE").when(score > 0, "FLAGGED").otherwise("CLEAR")
    )


def thermo_explanation(t: Column, rh: Column, td: Column, violations: Column) -> Column:
    return (
        F.when(
            t.isNull() | rh.isNull(),
            "Insufficient parameter data to evaluate physical/multivariate consistency.",
        )
        .when(F.size(violations) > 0, F.concat_ws("; ", violations))
        .when(td.isNull(), "Parameters conform to thermodynamic physical laws.")
        .otherwise(
            F.format_string(
                "Parameters conform to thermodynamic physical laws (Dew point: %.1f°C at %.1f%% RH).",
                td,
                rh,
            )
        )
    )
