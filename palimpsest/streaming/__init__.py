"""Structured Streaming into a store and over versions."""
