"""Part of chronoloom; see README.md."""
