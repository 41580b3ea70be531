"""A Spark-native engine for folders of Markdown notes."""
