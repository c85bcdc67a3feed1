"""Dataset profiling, quality, cleaning and analysis operators on PySpark DataFrames."""
