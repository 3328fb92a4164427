"""Plans made of operators: preparation of rows, the fit, its results."""
