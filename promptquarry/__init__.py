"""Prompt-corpus analytics on Spark."""
