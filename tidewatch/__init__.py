"""Tidewatch: a PySpark-native engine for website change monitoring and corpus preparation."""
