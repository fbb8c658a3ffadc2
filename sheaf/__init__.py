"""Document and catalogue analytics on PySpark DataFrames."""
