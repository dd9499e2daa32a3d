"""Structured Streaming intake and windows."""
