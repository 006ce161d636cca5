"""All registered queries, each with the SQL that must give the same rows."""

from tallyflow.plans.catalog import (
    aggregates,
    guarding,
    monitoring,
    reading,
    reports,
    shaping,
    sizes,
    sketches,
)
from tallyflow.plans.catalog.base import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "aggregates",
    "guarding",
    "monitoring",
    "reading",
    "reports",
    "shaping",
    "sizes",
    "sketches",
]
