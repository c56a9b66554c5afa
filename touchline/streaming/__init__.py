"""touchline.streaming."""
