"""Analytics over quiz-question corpora, planned by Spark."""
