"""graphloom: PySpark-native analytics for educational knowledge graphs."""
