"""Warehouse operators: star build, quality gate, analytics, series,
operational reads, dataset validation, intake and run audit."""
