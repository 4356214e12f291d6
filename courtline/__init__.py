"""Contest analytics on Spark: game facts, ratings, point-in-time features, matchups and page ingest."""
