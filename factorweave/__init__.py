"""Spark jobs for linear factor models over large asset panels, plus training-data operators in ``llm``."""
