"""Negative-space analytics on Spark: learn the conventions data follows, report where they break."""
