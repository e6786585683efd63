"""Full-text search and corpus analytics over digitised documents, as Spark plans."""

__version__ = "0.1.0"
