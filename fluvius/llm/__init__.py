"""Operators for preparing training data.  Nothing else in fluvius imports this."""
