"""Question-to-SQL evaluation, retrieval and curation as Spark DataFrame jobs."""
