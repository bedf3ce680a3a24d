"""Plan construction helpers: layout canonicalisation and plan checks."""
