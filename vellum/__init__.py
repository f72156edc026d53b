"""vellum: a PySpark-native engine for reviewing collections of manuscripts."""
