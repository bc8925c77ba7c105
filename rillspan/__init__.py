"""rillspan: byte-stream search, flow analytics and correlation on Apache Spark."""

__version__ = "0.1.0"
