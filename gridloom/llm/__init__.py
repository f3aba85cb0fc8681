"""Operators for large text collections; each module holds one operator."""
