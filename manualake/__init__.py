"""manualake: a Spark-native engine over a knowledge base of technical manuals."""
