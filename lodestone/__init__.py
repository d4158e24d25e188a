"""Lodestone: code and document search and analytics on Spark."""
