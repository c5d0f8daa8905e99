"""Sequential kernels: plain Python/numpy state machines that batch and streaming queries share."""
