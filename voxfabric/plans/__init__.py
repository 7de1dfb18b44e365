"""Plans made on the driver from small catalog tables."""
