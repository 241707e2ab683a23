"""gradewalk: slope-aware walking accessibility analytics on Spark DataFrames."""
