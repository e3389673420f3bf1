"""Tidepool: a PySpark-native engine for long-lived memory records."""
