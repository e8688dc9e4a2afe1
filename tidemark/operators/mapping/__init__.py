"""Alias rules that bring the names of spend and events together."""
