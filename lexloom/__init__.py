"""lexloom: document ingestion and hybrid retrieval as lazy Spark plans."""
