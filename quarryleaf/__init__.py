"""A PySpark library of corpus and bibliometric operators: DataFrames in, DataFrames out."""
