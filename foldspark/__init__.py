"""foldspark: PySpark-native analytics for irregular time series and their catalogs."""

__version__ = "0.1.0"
