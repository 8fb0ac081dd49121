"""meander: two-level time-series and spatial analytics on PySpark."""
