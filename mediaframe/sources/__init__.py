"""Readers and writers of frames, sound, subtitles and JSON side files."""
