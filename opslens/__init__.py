"""Operations analytics on Spark DataFrames."""
