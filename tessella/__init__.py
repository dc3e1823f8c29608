"""Corpus analytics on Spark: declarative plans for corpus engineering, log analytics and evaluation."""
