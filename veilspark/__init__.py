"""Document de-identification, audit and text-curation operators on Spark DataFrames."""

__version__ = "0.1.0"
