"""molquarry: a Spark-first engine for verifiable molecule question answering data."""

__version__ = "0.1.0"
