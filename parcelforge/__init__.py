"""Land-record analytics on Spark: normalisation, rules, triage, reads and rollups over DataFrames."""
