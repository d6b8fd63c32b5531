"""Part of fluvius."""
