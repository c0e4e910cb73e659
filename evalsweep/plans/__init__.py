"""Registered queries, their input views and the equivalent SQL."""
