"""Tessera: a PySpark-native engine for record tables built from semi-structured web pages."""
