"""Grid statistics over very large point tables, expressed as Spark plans."""

__version__ = "0.1.0"
