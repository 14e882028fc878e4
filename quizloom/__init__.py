"""quizloom: a PySpark-native engine for question-bank and learning-activity data."""
