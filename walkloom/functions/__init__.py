"""Part of walkloom; see the README."""
