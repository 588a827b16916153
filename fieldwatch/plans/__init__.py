"""Query registry: one module per operator family."""

from importlib import import_module

FAMILIES = (
    "q_qc",
    "q_tables",
    "q_cleaning",
    "q_structure",
    "q_profile",
    "q_hourly",
    "q_physics",
    "q_features",
    "q_spatial",
    "q_health",
    "q_fusion",
    "q_alerts",
    "q_models",
    "q_decisions",
    "q_streaming",
)


def catalogs():
    return [import_module(f"fieldwatch.plans.{m}").cat for m in FAMILIES]
