"""touchline.operators."""
