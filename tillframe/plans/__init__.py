"""The load pipeline, the query registry and the checking SQL."""
