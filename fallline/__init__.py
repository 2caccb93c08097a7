"""Fallline: terrain segmentation and training-data operators on PySpark DataFrames."""

from fallline.grid import GridSpec
from fallline.operators.regions import clean, polygons, segmentation_metrics
from fallline.operators.stencil import adjacency, boundary, display_class
from fallline.plans.pipeline import Optimizer, Settings, SlopeUnits, write_units
from fallline.plans.resources import ResourcePlan, SystemResources, detect_system_resources, make_resource_plan
from fallline.plans.schedule import StorageEstimate, ThresholdLevel, estimate_work_storage, threshold_schedule

__version__ = "0.1.0"
__all__ = [
    "GridSpec", "Optimizer", "ResourcePlan", "Settings", "SlopeUnits", "StorageEstimate", "SystemResources", "ThresholdLevel",
    "adjacency", "boundary", "clean", "detect_system_resources", "display_class", "estimate_work_storage", "make_resource_plan", "polygons", "segmentation_metrics",
    "threshold_schedule", "write_units",
]
