"""kinweave: typed-graph assembly, embedding and association testing on Spark DataFrames."""
