"""Sinks: review spreadsheets and tracked-changes documents."""
