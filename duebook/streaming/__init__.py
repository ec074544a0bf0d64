"""Arrivals of new invoices and payments as Structured Streaming jobs."""
