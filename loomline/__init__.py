"""loomline: a PySpark-native engine for agent-session logs and training text."""
