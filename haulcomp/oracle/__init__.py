"""The queries once more as plain SQL, written from the definitions and not from the plans."""
