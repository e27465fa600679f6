"""twinweave: matching versions of typed object graphs as Spark DataFrame jobs."""
