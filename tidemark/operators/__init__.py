"""Operators on bars, feature rows, neighbours, graphs and labels."""
