"""Composed jobs: patient table, case preparation, scoring, evaluation, profile."""
