"""Literature and evidence pipelines on Spark."""
