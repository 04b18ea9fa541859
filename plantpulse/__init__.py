"""plantpulse: multi-tenant industrial sensor telemetry on PySpark DataFrames."""
