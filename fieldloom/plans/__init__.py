"""Driver-side objects that compile to DataFrame stages: layouts and models."""
