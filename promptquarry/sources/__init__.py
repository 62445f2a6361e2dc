"""Readers and writers of transcripts, snapshots, context files and configuration."""
