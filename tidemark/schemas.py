"""Frozen table schemas and the columns optional modes add (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "t": T.TimestampType()}


def table(spec: str) -> T.StructType:
    """'name:kind ...' with kinds s, d, i, l, b, t."""
    return T.StructType([T.StructField(n, _KIND[k]) for n, k in (item.split(":") for item in spec.split())])


SEIZURES = table("subject_id:s region:s session_start:t source_file:s seizure_id:i start_s:d end_s:d duration_s:d start_abs:t end_abs:t "
                 "block_id:i adjacent_to_gap:b seizure_mode:s over_max_duration:b ll_ratio:d peak_energy_ratio:d hf_ratio_db:d envelope_cv:d")
BILATERAL = table("channel_seizure_id:i detection_status:s accepted_in_n_channels:i accepted_in_regions:s n_channels_total:i "
                  "is_bilateral_accepted:b fragmented:b ref_start_s:d ref_end_s:d rejected_by:s")
EVENT = table("ll_status:s event_id:i category:s n_accepted:i n_in_band:i n_channels_in_group:i fragmented:b hemisphere:s "
              "accepted_in_regions:s ref_start_s:d ref_end_s:d")
COMPLEXES = table("subject_id:s region:s session_start:t source_file:s complex_id:i start_s:d end_s:d start_abs:t end_abs:t duration_ms:d "
                  "n_spikes:i classification:s max_amplitude_mV:d mean_amplitude_mV:d in_burst:b burst_id:i")
BURSTS = table("subject_id:s region:s start_s:d end_s:d start_abs:t end_abs:t duration_s:d n_complexes:i")
GAPS = table("gap_id:i start_s:d end_s:d duration_s:d start_abs:t end_abs:t prev_record_idx:i next_record_idx:i source_file:s")
GROUND_TRUTH = table("subject_id:s region:s start_abs:t end_abs:t notes:s")

# column that tells an optional mode was on -> the columns it brings
MODES = {"detection_status": BILATERAL, "category": EVENT}


def add_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns of a mode that are missing: given default, '' for text, FALSE for flags, else NULL."""
    base = {"string": "", "boolean": False}
    new = {}
    for f in schema.fields:
        if f.name not in df.columns:
            value = (defaults or {}).get(f.name, base.get(f.dataType.simpleString()))
            new[f.name] = F.lit(value).cast(f.dataType)
    return df.withColumns(new) if new else df


def shaped(df: DataFrame, schema: T.StructType, names: dict | None = None) -> DataFrame:
    """Rows under a public schema: renamed, reordered, typed, missing columns defaulted."""
    for new, old in (names or {}).items():
        df = df.withColumnRenamed(old, new)
    df = add_columns(df, schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
