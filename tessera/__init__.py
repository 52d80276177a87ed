"""tessera: embedding inference and request-log analytics on Spark.

Subpackages
-----------
sources    dataset / image / request-stream scans
sinks      parquet, manifests, metric exposition, log records
functions  column expressions (urls, vectors, images)
operators  DataFrame operators (samples, validation, encode, metrics, requests, top-k)
models     encoder plug-ins and their loader
plans      end-to-end jobs built from the operators
streaming  Structured Streaming forms of the operators
"""

__version__ = "0.1.0"
