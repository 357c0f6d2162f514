"""The operators that an agent may call, by name; each is a function from DataFrames and parameters to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from changeprism.operators import coupling, graph, incidents, report, units

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "ownership": units.ownership_history,
    "co_change": coupling.partner_shares,
    "coupling": graph.structural_coupling,
    "incidents": graph.incident_history,
    "incident_counts": incidents.incident_counts,
    "similar_incidents": report.similar,
    "blast_radius": graph.dependents,
    "blast_incidents": graph.blast_incidents,
    "recent_commits": units.recent_changes,
    "risk_report": report.risk_report,
}


def call(name: str, *args, **parameters) -> DataFrame:
    """The result of a tool; an unknown name is a KeyError that lists the known ones."""
    if name not in TOOLS:
        raise KeyError(f"{name} is none of {', '.join(TOOLS)}")
    return TOOLS[name](*args, **parameters)
