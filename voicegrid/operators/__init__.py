"""DataFrame operators: ingestion, statistics, sentiment, topics, aspects, trends, insights."""
