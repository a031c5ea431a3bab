"""Part of trapflow."""
