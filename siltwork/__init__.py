"""siltwork: a Spark-first engine for retrieval, citation-graph and corpus analytics."""
