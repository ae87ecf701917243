"""PySpark-native engine for timed text, intervals and time series."""
