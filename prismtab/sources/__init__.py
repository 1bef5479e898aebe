"""Readers and writers: delimited text, sectioned reports, spreadsheets, stored datasets."""
