"""Reading inputs, rejecting bad rows, storing results."""
