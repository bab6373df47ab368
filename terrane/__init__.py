"""Feature assembly and export on Spark.

Catalog grouping, geometry detection, feature assembly, geometry union, export
sinks, run history and an export-duration model, all as DataFrame jobs.
"""
