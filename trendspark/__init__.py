"""trendspark: content-trend analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    table scans, test-table adapters, file sources and sinks
functions  column expressions (numeric, temporal, text, arrays, scoring)
operators  DataFrame -> DataFrame operators (filters, lookups, aggregates,
           windows, top-k, set operations, statistics)
plans      composite analyses (contract reports, feature matrix, insight report)
streaming  snapshot ingest and progression shared by batch and Structured Streaming
ml         targets, split, training, tuning, selection, ensembles, scoring
"""

__version__ = "0.1.0"
