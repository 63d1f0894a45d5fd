"""Retail demand planning on the DataFrame API."""
