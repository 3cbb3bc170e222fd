"""Whole plans: extraction, question answering, reports."""
