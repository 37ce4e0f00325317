"""Text-corpus analytics on Spark: retrieval, extraction, alignment and evaluation as DataFrame plans."""
