"""Operators put together: the assembly that documents stand for, its queries, and the same in SQL."""
