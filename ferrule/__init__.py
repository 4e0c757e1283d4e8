"""Document-to-tables extraction and record-processing engine on PySpark DataFrames."""
