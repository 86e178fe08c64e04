"""PySpark-native analytics for LLM request traffic."""
