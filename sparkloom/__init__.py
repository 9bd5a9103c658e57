"""A PySpark-native engine for document retrieval, metering, event processing and corpus preparation."""
