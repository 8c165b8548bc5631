"""Image operators over DataFrames of packed rasters."""
