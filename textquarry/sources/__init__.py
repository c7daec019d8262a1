"""Sources and sinks: file trees, chat sessions, notes and the index tables."""
