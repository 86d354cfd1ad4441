"""Pure decoders from bytes to Python values; no Spark here."""
