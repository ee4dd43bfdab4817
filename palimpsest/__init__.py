"""palimpsest: a Spark-native engine for mirroring sites in another language.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans it.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
