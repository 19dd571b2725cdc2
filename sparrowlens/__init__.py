"""Semantic vector search and analytics as Spark jobs.

``functions`` builds columns, ``operators`` builds DataFrames, ``sources`` reads and
writes the model and the store, ``streaming`` keeps the store up to date, ``plans``
holds what multi-pass jobs share.
"""

__version__ = "0.1.0"
