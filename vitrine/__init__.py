"""Catalogue analytics and product search as lazy Spark plans."""
