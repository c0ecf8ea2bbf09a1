"""Operators over unbounded inputs."""
