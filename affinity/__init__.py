"""affinity: a PySpark-native analytics engine for affiliation networks."""

from __future__ import annotations

from importlib import import_module

SCHEMA_VERSION = "1.0.0"
#: Where what the package offers is found; it is imported when first asked for.
_PLACES = {
    "affinity.errors": ["AffinityError", "ParseError", "StorageError"],
    "affinity.functions.enrich": ["enrich"],
    "affinity.functions.text": ["canonical_company", "clean_title", "job_function", "seniority"],
    "affinity.operators.network": ["cooccurrence_edges", "graph_payload"],
    "affinity.operators.sections": ["completeness", "concentration", "entity_resolution", "overview", "seniority_drift", "structure"],
    "affinity.operators.temporal": ["activity", "era_days", "era_profile"],
    "affinity.plans.analysis": ["analyze", "analyze_bytes", "analyze_path"],
    "affinity.plans.insights": ["generate"],
    "affinity.plans.report": ["markdown"],
    "affinity.settings": ["Settings"],
    "affinity.sources.export": ["ParseReport", "from_rows", "iter_names", "read_export"],
}
_FOUND_IN = {name: place for place, names in _PLACES.items() for name in names}
__all__ = ["SCHEMA_VERSION", *_FOUND_IN]


def __getattr__(name: str):
    if name in _FOUND_IN:
        return getattr(import_module(_FOUND_IN[name]), name)
    raise AttributeError(name)
