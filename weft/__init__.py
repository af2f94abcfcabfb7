"""weft: thread retrieval, evidence packing and corpus preparation as Spark plans."""
