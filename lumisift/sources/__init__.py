"""Files, captions and archives in and out."""
