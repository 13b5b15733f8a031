"""textloom: corpus-scale document and source-version comparison on Spark."""
