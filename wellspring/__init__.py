"""Drilling telemetry analytics on Spark."""

from wellspring.operators.features import add_features
from wellspring.operators.imputation import handle_missing
from wellspring.operators.isolation import isolation_flags
from wellspring.operators.learning import build_classifier
from wellspring.operators.outliers import flag_outliers
from wellspring.operators.validation import validate_structure
from wellspring.plans.processing import ProcessingConfig, process, process_file
from wellspring.plans.quality import quality_report
from wellspring.session import build_session

__all__ = [
    "ProcessingConfig", "add_features", "build_classifier", "build_session", "flag_outliers", "handle_missing",
    "isolation_flags", "process", "process_file", "quality_report", "validate_structure",
]
