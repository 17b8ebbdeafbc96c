"""glossa: a PySpark-native engine for reviewing documents against a versioned glossary."""
