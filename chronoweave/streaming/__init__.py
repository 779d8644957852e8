"""Streams of episodes."""
