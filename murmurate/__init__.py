"""A PySpark-native catalog and SQL layer with operators for records, logs and event folds."""
