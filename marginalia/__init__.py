"""marginalia: retrieval, knowledge-graph and corpus analytics over note vaults, on Spark DataFrames."""
