"""Declared tables: manifest, run rows, detail rows, chat records, scenario specs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Column names and order of the shared result tables.
SETTING_FIELDS = [
    ("run_id", _S), ("dataset_key", _S), ("dataset_name", _S), ("target_column", _S),
    ("scenario_family", _S), ("missingness_type", _S), ("mcar_scope", _S)]
MANIFEST = _struct(
    *SETTING_FIELDS,
    ("mar_dependency_column", _S), ("mnar_driver_column", _S),
    ("mcar_global_excluded_columns", _S), ("rate_pct", _I), ("seed", _I),
    ("method_family", _S), ("method_key", _S), ("method_name", _S), ("model_key", _S),
    ("model_name", _S), ("include_in_primary_leaderboard", _B),
    ("include_in_secondary_full_matrix", _B))
CLASSICAL_RUN = _struct(
    ("run_id", _S), ("run_timestamp_utc", _S), *SETTING_FIELDS[1:],
    ("rate_pct", _I), ("seed", _I), ("method_family", _S), ("method_key", _S),
    ("method_name", _S), ("model_key", _S), ("model_name", _S), ("status", _S),
    ("error_message", _S), ("full_path", _S), ("missing_path", _S), ("n_masked_target", _L),
    ("mean_rmse", _D), ("mean_nrmse", _D), ("runtime_seconds", _D))
RUN = T.StructType([
    *CLASSICAL_RUN.fields,
    *_struct(("fallback_rate", _D), ("source_file", _S), ("source_type", _S),
             ("provenance_note", _S)).fields])
PROMPT_RUN = T.StructType([*RUN.fields, T.StructField("few_shot_k", _I)])
MODEL_DETAIL = _struct(
    ("row_index", _L), ("prediction", _D), ("ground_truth", _D), ("abs_error", _D),
    ("source", _S), ("raw_output", _S), ("model_name", _S), ("adapter_path", _S),
    ("prompt_style", _S), ("run_timestamp_utc", _S))
CHAT_RECORD = _struct(
    ("messages", T.ArrayType(_struct(("role", _S), ("content", _S)))))
PREPARE_ROW = _struct(
    ("input_table", _S), ("mechanism", _S), ("target_column", _S), ("status", _S),
    ("reason", _S), ("output", _S), ("n_rows", _L), ("n_examples", _L),
    ("n_missing_target", _L), ("n_observed_target", _L))
RUN_KEY = ["dataset_key", "scenario_family", "rate_pct", "seed", "method_key", "model_key"]
