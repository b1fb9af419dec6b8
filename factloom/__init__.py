"""Code and text fact analytics on PySpark DataFrames."""
