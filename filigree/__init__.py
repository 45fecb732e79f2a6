"""A relationship-graph analytics engine on Spark DataFrames."""
