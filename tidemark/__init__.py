"""Spark-first engine for web-article analytics."""

from tidemark._shipping import ship

ship(__name__)
