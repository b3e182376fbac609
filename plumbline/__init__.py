"""plumbline: structural analytics over code graphs, as Spark DataFrame plans."""

__version__ = "0.1.0"
