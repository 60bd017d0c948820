"""A Spark-native engine for PostgreSQL-flavoured SQL."""
