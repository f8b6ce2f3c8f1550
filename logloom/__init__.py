"""Call-log and document-review analytics expressed as Spark DataFrame jobs."""
