"""voxfabric: multi-view, multi-resolution array queries expressed as Spark DataFrames."""
