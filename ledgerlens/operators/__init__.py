"""Operators: KPI aggregates, fraud profiles, pattern detection, data quality."""
