"""figloom: declarative chart-oriented analytics on Spark DataFrames."""
