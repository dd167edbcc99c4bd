"""cinegrid: search, profiling and corpus preparation for media catalogues, on Spark DataFrames."""

__version__ = "0.1.0"
