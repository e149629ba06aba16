"""lexdelta: a PySpark-native engine for comparing versions of structured legislative text."""
