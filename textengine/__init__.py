"""A PySpark-native engine for labelled text: functions from DataFrame to DataFrame."""
