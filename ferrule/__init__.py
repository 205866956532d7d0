"""ferrule: rule discovery, verification and sampling over wide tables, as Spark plans."""

__version__ = "0.1.0"
