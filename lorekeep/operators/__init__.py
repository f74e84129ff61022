"""Operators on tables of a retrieval service, one module per area."""

from lorekeep.sources import views  # noqa: F401  the tables that operators name
