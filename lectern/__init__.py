"""Lectern: a PySpark-native engine for organising and searching note collections."""
