"""Column contracts of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = (
    "dataset string, recording_id string, idx bigint, ts_ns bigint, ts_s double, "
    "fx double, fy double, fz double, wx double, wy double, wz double"
)
STREAMS = (
    "dataset string, recording_id string, dependency_group string, idx bigint, "
    "ts_s double, q_f double, q_w double, native_index bigint"
)
FOLDS = (
    "fold_id string, evaluation_class string, source_or_domain string, split_role string, "
    "dataset string, sequence_id string, dependency_group string, notes string"
)
FINDINGS = (
    "dataset string, recording_id string, check_id string, category string, severity string, "
    "status string, observed string, expected string, action string"
)
MANIFEST = (
    "dataset string, sequence_id string, content_role string, local_path string, "
    "download_status string, sha256 string, downloaded_size_bytes string"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select the schema's columns in order; missing ones become NULL, others go."""
    fields = [field.split() for field in schema.split(",")]
    return df.select(
        *[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields]
    )
