"""Column functions: air-quality index, physics, time, geography."""
