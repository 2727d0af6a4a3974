"""Chains of transforms and whole transfers."""
