"""Training-data operators for language models; nothing outside this subpackage imports it."""
