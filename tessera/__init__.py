"""tessera: retrieval, evidence packing and corpus preparation as Spark DataFrame operators."""
