"""Readers and writers of frame lists, cameras, trajectories and clouds."""
