"""Operators over wafer maps and verdicts."""
