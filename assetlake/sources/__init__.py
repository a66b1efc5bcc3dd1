"""Readers and writers: corpus listing, container inventory, rule and preset JSON, reports."""
