"""Readers; each one has a fixed schema and returns a DataFrame."""

from burstlens.sources.annotations import (
    read_annotation_csv,
    read_coco,
    read_coco_tables,
    read_part_tables,
)
from burstlens.sources.detections import read_detections
from burstlens.sources.images import list_images, read_images
from burstlens.sources.manifest import read_manifest

__all__ = [
    "list_images",
    "read_annotation_csv",
    "read_coco",
    "read_coco_tables",
    "read_detections",
    "read_images",
    "read_manifest",
    "read_part_tables",
]
