"""Sources and sinks: files in, exports out."""
