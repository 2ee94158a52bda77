"""quillspark: survey-text analytics expressed as Spark DataFrame operations."""
