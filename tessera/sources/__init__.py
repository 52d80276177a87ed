"""Scans: dataset shards, image bytes and decoded images, request streams."""
