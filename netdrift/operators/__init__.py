"""The jobs: DataFrame in, DataFrame out."""
