"""callscope: a PySpark-native analytics engine for LLM gateway logs."""
