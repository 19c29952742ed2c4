"""tmengine: translation-memory, retrieval and work-unit jobs as plain PySpark DataFrame code."""

__version__ = "0.1.0"
