"""Image processing and table analytics on PySpark DataFrames."""
