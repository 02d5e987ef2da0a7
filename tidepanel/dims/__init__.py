"""Dimension tables that ship with the library."""
