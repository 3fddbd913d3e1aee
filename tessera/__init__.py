"""tessera: decision-support queries over star-schema tables, planned by Spark."""
