"""Sources: the given tables (batch or as a stream), replayed file topics,
Kafka through Spark's connector, and object-store settings."""
