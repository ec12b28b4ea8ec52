"""Transition systems from tables, generators and text."""
