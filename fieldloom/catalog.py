"""All registered queries of the panel operators, and the SQL that checks them."""

from __future__ import annotations

from fieldloom.queries import ORACLE, QUERIES, analysis, ensembles, files, inference, quality, relations, space, time

__all__ = ["ORACLE", "QUERIES"]

_MODULES = (time, relations, ensembles, analysis, space, quality, inference, files)
