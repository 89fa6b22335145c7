"""One function per stage: DataFrames in, one DataFrame out."""
