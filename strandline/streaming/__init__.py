"""Micro-batch runs over file streams."""
