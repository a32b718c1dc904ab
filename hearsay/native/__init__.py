"""Encoders as Catalyst expressions."""
