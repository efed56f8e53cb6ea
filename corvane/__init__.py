"""A retrieval and analytics engine on Spark: typed collections, filters, vector, text and fused search."""
