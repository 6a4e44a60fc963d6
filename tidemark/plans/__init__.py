"""From statements to tables and DataFrames."""
