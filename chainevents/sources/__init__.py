"""Archive files, checksum lists, scopes, event ABIs and stored tables."""
