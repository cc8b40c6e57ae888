"""Retrieval over multimodal knowledge graphs and answer evaluation as Spark DataFrame plans."""
