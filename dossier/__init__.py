"""Document intelligence on Spark: ingest, graph, retrieval, routing and analytics."""
