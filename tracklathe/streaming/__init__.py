"""Nothing streams in the analysis; this folder holds file-stream ingestion for those who want it."""
