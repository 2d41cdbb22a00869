"""Population-scale analysis of bacterial sequencing isolates on Spark DataFrames."""
