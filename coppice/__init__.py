"""coppice: tree, retrieval and corpus operators for code collections, declared on Spark DataFrames."""
