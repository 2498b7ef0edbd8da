"""Text-to-knowledge-graph data pipelines as Spark plans."""
