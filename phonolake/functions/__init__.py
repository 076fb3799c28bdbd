"""Column functions and the model interface."""
