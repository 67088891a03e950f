"""Texts of documents: cleaning, versions, differences, sections."""
