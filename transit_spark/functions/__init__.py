"""Column functions: text, dates, geometry, roads and costs."""
