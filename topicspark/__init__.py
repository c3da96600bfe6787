"""Topic analytics over document tables, as Spark queries."""
