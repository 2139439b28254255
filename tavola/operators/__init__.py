"""Cleaning jobs and the named questions over listings and orders."""
