"""Query catalogue: name to callable, and name to the SQL that must agree with it."""

from __future__ import annotations

from . import group_capture, group_joins, group_measure, group_rules, group_scoring, group_spatial

GROUPS = (group_scoring, group_spatial, group_joins, group_rules, group_measure, group_capture)
QUERIES: dict = {name: f for g in GROUPS for name, f in g.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for g in GROUPS for name, sql in g.ORACLES.items()}
