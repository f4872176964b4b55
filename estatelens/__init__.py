"""estatelens: data-estate profiling, relationship discovery, catalog evidence and drift on Spark."""

__version__ = "0.1.0"
