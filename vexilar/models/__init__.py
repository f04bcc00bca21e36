"""Networks on I/Q records in numpy: gradients, layers, losses, training by tasks, extraction."""
