"""DataFrame operators: stations, features, fires, grids, spatial statistics, transport, models."""
