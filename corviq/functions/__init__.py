"""Part of corviq."""
