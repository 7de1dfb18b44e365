"""Where arrays and catalogs come from."""
