"""Dataset curation on Spark: clean, score, de-duplicate, label and export text tables with DataFrames."""
