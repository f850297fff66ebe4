"""Scans and sinks: test-table raster views, the Parquet catalog, GeoTIFF, text."""
