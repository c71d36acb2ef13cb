"""Text retrieval, ranking and document intelligence on PySpark DataFrames."""
