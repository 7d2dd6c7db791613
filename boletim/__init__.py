"""Reports on school networks, computed as lazy Spark DataFrames."""
