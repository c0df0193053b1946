"""A PySpark-native engine for facts about compiled archives."""
