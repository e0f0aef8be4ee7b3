"""Operators for preparing text corpora on Spark. Nothing else in marlstone imports this."""
