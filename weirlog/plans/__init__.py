"""Documents composed from several operators: metric contexts, prompts, answers."""
