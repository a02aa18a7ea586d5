"""Training-data operators over document corpora; nothing outside this subpackage imports it."""
