"""Data-quality auditing of training sets, as Spark plans."""
