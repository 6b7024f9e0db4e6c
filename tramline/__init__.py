"""tramline: match-tracking analytics on PySpark DataFrames."""
