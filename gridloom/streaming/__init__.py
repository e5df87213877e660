"""Streams of pixels, features and detections."""
