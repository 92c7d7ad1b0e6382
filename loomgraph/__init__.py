"""loomgraph: building and judging knowledge graphs from text and tables on Spark."""
