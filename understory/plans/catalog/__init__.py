"""Registered queries, one per operator, grouped by topic."""

from understory.plans.catalog import aggregates, ecology_spatial, forests, models, sources_sinks, verbs_joins  # noqa: F401
