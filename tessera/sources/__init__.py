"""Input schemas, the European CSV reader and views that reshape star-schema tables."""
