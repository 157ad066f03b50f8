"""rillworks: log collection, routing and audit as Spark jobs."""
