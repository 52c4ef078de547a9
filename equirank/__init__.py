"""Fair-retrieval analytics as DataFrame -> DataFrame functions on Spark."""
