"""sedgework: a document store, property graph and data-preparation engine on PySpark."""

__version__ = "0.1.0"
