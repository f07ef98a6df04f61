"""tarn: evidence retrieval, answer verification and corpus preparation as Spark jobs."""
