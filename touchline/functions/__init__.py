"""touchline.functions."""
