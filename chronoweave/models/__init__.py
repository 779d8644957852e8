"""The seam to language and embedding models."""
