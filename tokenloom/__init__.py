"""Corpus preparation and analysis for language-model training data, as PySpark jobs."""
