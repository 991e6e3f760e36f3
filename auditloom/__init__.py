"""auditloom: Spark jobs that prepare, chunk, check and evaluate large document collections."""
