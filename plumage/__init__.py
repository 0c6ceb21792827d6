"""Spark-native analytics over ordered, versioned documents, detections, text, rasters and event logs."""
