"""User-level operators; each is a function DataFrame -> DataFrame."""
