"""Column expressions: text, peaks, vectors, keyed random numbers, model inputs."""
