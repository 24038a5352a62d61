"""Tables, closed value sets and defaults of the transcript store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed sets of the data model, in their natural order.
CATEGORIES = ("architecture_decisions", "exploration", "bug_fix", "friction_audit", "ai_correction_load", "high_potential_seeds", "mechanical_labor")
CATEGORY_TITLES = ("Architecture Decisions", "Exploration", "Bug Fix", "Friction Audit", "AI Correction Load", "High-Potential Seeds", "Mechanical Labor")
EFFORT_CLASSES = ("toil", "judgment", "overhead")
ENGAGEMENT_CLASSES = ("directive", "deliberative", "corrective", "acknowledgment")
NOISE_TYPES = ("attachment", "mode", "permission-mode", "queue-operation", "system", "file-history-snapshot", "file-history-delta", "ai-title")

TABLES: dict[str, str] = {
    "sessions": "project_dir string, session_id string, last_line int, last_run_at string, read_offset bigint, read_line int, islands array<struct<first:int,last:int>>",
    "episodes": "id bigint, date string, project_dir string, session_id string, start_line int, end_line int, label string",
    "insights": "id bigint, episode_id bigint, category string, text string, evidence_ref string, significance_score double, verified_by_git boolean, recurrence_of bigint, created_at string, effort_class string",
    "insight_grams": "gram string, insight_id bigint",
    "insight_embeddings": "insight_id bigint, embedding array<float>, model string, created_at string",
    "derived_insights": "id bigint, project_dir string, session_id string, label string, insight_type string, text string, evidence_insight_ids array<bigint>, created_at string",
    "engagement_turns": "id bigint, episode_id bigint, human_line_number int, classification string, directive_necessary boolean, reason string, created_at string",
    "answers": "kind string, name string, answer string",
    "jobs": "id string, kind string, status string, result string, error string, created_at string, updated_at string",
}
#: What a column added by a later version of a table holds in rows written before.
DEFAULTS = {"effort_class": "judgment", "label": "", "last_line": 0}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns: missing ones get their default or null, all get their type."""
    have = set(df.columns)
    columns = []
    for f in struct(table).fields:
        default = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        value = F.col(f.name).cast(f.dataType) if f.name in have else default
        columns.append((F.coalesce(value, default) if f.name in DEFAULTS else value).alias(f.name))
    return df.select(*columns)
