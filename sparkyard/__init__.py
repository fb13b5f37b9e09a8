"""A PySpark-native engine that turns noisy timed evidence into audited sale records."""
