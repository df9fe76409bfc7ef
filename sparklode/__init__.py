"""sparklode: a token index and search engine for Parquet data, expressed as Spark DataFrames."""

__version__ = "0.1.0"
