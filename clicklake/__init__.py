"""Click-log analytics and retrieval as Spark DataFrame operators."""
