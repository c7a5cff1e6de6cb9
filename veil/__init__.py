"""Personal-data detection and surrogate replacement as Spark DataFrame operators."""

__version__ = "0.1.0"
