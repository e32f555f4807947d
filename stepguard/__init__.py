"""Rule-based anomaly labelling, dataset building and evaluation on Spark DataFrames."""
