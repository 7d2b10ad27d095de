"""Registered queries, their SQL oracles and the multi-step jobs."""
