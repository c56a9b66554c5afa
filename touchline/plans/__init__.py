"""touchline.plans."""
