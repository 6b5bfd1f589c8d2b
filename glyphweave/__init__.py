"""Diachronic lexicon analytics on Spark."""
