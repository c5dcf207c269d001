"""Registered queries, each next to the SQL that checks it."""

from sketchframe.queries import io, models, reshaping, reports, sharing, sketches  # noqa: F401
from sketchframe.queries.registry import ORACLES, QUERIES  # noqa: F401
