"""Data mining and text analytics on PySpark DataFrames."""
