"""The engine's counts as structured streams."""
