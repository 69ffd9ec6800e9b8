"""Text-dataset curation, retrieval, tagging and model evaluation on PySpark."""
