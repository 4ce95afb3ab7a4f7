"""Motif analytics on Spark: finding, scanning, evaluating and clustering weighted sequence patterns as DataFrame plans."""
