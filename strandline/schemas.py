"""Schemas of triple files and decision tables; always given, never inferred."""

# The fields of the files.
RAW_TRIPLE = (
    "subject STRUCT<name: STRING, type: STRING>, relation STRING, object STRUCT<name: STRING, type: STRING>, "
    "reasoning STRING, source_id STRING, source_file STRING, source_index INT"
)
VALIDATED_TRIPLE = (
    "subject STRUCT<name: STRING, type: STRING, display_name: STRING>, relation STRING, object STRUCT<name: STRING, type: STRING, display_name: STRING>, "
    "reasoning STRING, source_id STRING, source_file STRING, source_index INT, "
    "validation_history STRUCT<"
    "step_1: STRUCT<step_1_list_check: STRING, step_2_alignment_check: STRING, response: STRING, reason: STRING>, "
    "step_2: STRUCT<granularity_analysis: STRING, response: STRING, standard_subject: STRING, standard_object: STRING, reason: STRING>, "
    "step_3: STRUCT<step_1_rule_matching: STRING, response: STRING, reason: STRING>>, "
    "reject_reason STRING, "
    "original_raw_triple STRUCT<subject: STRUCT<name: STRING, type: STRING>, relation: STRING, object: STRUCT<name: STRING, type: STRING>, "
    "reasoning: STRING, source_id: STRING, source_file: STRING, source_index: INT>"
)
MERGE_DECISION = "name_a STRING, type_a STRING, name_b STRING, type_b STRING, similarity DOUBLE, decision STRING, confidence DOUBLE, reason STRING"
