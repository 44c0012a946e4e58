"""Find and mask personal data in document collections, as Spark DataFrame jobs."""
