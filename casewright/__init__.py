"""casewright: patient-level case cohorts and model evaluation as Spark DataFrames."""

__version__ = "0.1.0"
