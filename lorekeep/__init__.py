"""lorekeep: a provenance-first knowledge catalogue and corpus engine expressed as Spark plans."""

__version__ = "0.1.0"
