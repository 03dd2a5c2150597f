"""Part of attestor."""
