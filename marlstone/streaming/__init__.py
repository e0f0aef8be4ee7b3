"""Structured Streaming over the query log and over entity mentions."""
