"""Array analytics on Spark: catalogs, N-d scans, codecs and workload analytics as DataFrames."""

__version__ = "0.1.0"
