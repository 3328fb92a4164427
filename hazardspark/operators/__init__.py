"""Operators on prepared and unprepared rows, each a DataFrame to a DataFrame."""
