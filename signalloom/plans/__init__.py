"""Configuration, validation and planning."""
