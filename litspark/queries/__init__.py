"""One registered query for each operator, over the driver's tables."""
