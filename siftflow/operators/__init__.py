"""Operators: a node of the plan and a frame give a frame, lazily."""
