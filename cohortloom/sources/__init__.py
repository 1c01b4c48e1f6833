"""Readers and writers (SRC, SNK) and table contracts (QA-05)."""
