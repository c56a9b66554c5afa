"""touchline.sources."""
