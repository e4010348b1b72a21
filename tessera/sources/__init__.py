"""Tables, stores and catalogs as DataFrames."""
