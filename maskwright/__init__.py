"""De-identification and re-identification of text and tables as Spark jobs."""
