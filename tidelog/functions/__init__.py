"""Column functions: the entry codec, digests and path algebra."""
