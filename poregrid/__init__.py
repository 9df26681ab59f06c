"""Tunnel and transport analytics on Spark: scans, operators, plans and sinks as DataFrame programs."""

__version__ = "0.1.0"
