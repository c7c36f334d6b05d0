"""Grid cells, curve keys and composite keys as column expressions, with scalar twins for the driver."""
