"""Bulk jobs over hash-chained event tables, as DataFrame plans."""
