"""The study's stages, composed from the operators."""
