"""Column functions and the small vectorised helpers behind the Arrow UDFs."""
