"""PySpark-native clustering of large point sets in the presence of outliers."""
