"""Content-moderation analytics for linked articles, written as Spark jobs."""
