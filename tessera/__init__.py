"""tessera: profiling, validation and comparison of numeric tables and tensor files on Spark."""

__version__ = "0.1.0"
