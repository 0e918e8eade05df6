"""sceneqa: PySpark-native curation, sampling and scoring of question-answer and text corpora."""
