"""sketchwell: mergeable quantile summaries and group threshold queries on Spark."""
