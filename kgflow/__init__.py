"""kgflow: property graphs from document collections, as Spark DataFrames."""
