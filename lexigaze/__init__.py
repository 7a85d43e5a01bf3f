"""Looking-time and annotated-speech analytics as Spark DataFrame jobs."""
