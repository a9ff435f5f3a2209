"""File, table and dictionary sources."""
