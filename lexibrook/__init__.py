"""A document index and search engine on Spark."""
