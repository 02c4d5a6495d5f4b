"""Filing analytics on Spark: XBRL facts, filing text and a fact warehouse as DataFrames."""
