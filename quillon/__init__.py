"""quillon: relational, scalar, JSON and corpus operators declared as Spark plans."""

__version__ = "0.1.0"
