"""Judge evaluation over labelled text collections, as Spark DataFrame jobs."""

__version__ = "0.1.0"
