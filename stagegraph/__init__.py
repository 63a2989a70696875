"""stagegraph: staged dataflow, provenance and run analytics on Spark DataFrames."""
