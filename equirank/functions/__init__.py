"""Part of equirank; see README."""
