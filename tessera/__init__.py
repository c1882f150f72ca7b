"""Near-duplicate and provenance analytics on PySpark DataFrames."""
