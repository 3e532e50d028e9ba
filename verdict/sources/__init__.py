"""Scans, sinks, and the fixture derived from the driver's tables."""
