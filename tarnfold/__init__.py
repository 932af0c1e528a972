"""tarnfold: retrieval, knowledge-management and corpus operators on Spark DataFrames."""
