"""Structured Streaming forms of the live behaviours."""
