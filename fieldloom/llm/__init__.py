"""Text-corpus operators for large training-data pipelines."""
