"""The nine warehouse tables: columns, keys, partitioning, sort order."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from furlong.sources.layouts import COUNTER_GROUPS, COUNTERS

SPARK_TYPES = {
    "STRING": T.StringType(), "INT64": T.LongType(), "INTEGER": T.LongType(),
    "FLOAT64": T.DoubleType(), "FLOAT": T.DoubleType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
}


def struct_from_spec(spec: list[dict] | str) -> T.StructType:
    """Schema from JSON field specs (name, type, mode, description)."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    return T.StructType([
        T.StructField(f["name"], SPARK_TYPES[f["type"].upper()],
                      f.get("mode", "NULLABLE") != "REQUIRED",
                      {"comment": f.get("description", "")})
        for f in spec
    ])


def _spec(text: str) -> list[dict]:
    """One column per line: name, type, mode."""
    return [dict(zip(("name", "type", "mode"), line.split(), strict=True)) for line in text.strip().splitlines()]


# Column names, types and modes of the nine tables.
TABLE_SPECS = {
    "race_info": """
race_id STRING REQUIRED
race_date DATE REQUIRED
venue_code STRING NULLABLE
venue_name STRING NULLABLE
race_number INT64 NULLABLE
race_name STRING NULLABLE
course_type STRING NULLABLE
distance INT64 NULLABLE
direction STRING NULLABLE
race_class STRING NULLABLE
age_condition STRING NULLABLE
sex_condition STRING NULLABLE
weather STRING NULLABLE
track_condition STRING NULLABLE
num_horses INT64 NULLABLE
prize_1st INT64 NULLABLE
prize_2nd INT64 NULLABLE
prize_3rd INT64 NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "horse_results": """
race_id STRING REQUIRED
horse_number INT64 REQUIRED
horse_id STRING REQUIRED
horse_name STRING NULLABLE
idm FLOAT64 NULLABLE
jockey_index FLOAT64 NULLABLE
info_index FLOAT64 NULLABLE
total_index FLOAT64 NULLABLE
running_style INT64 NULLABLE
distance_aptitude INT64 NULLABLE
improvement INT64 NULLABLE
rotation INT64 NULLABLE
base_odds FLOAT64 NULLABLE
base_popularity INT64 NULLABLE
base_place_odds FLOAT64 NULLABLE
base_place_popularity INT64 NULLABLE
specific_mark_circle INT64 NULLABLE
specific_mark_circle2 INT64 NULLABLE
specific_mark_triangle INT64 NULLABLE
specific_mark_triangle2 INT64 NULLABLE
specific_mark_x INT64 NULLABLE
total_mark_circle INT64 NULLABLE
total_mark_circle2 INT64 NULLABLE
total_mark_triangle INT64 NULLABLE
total_mark_triangle2 INT64 NULLABLE
total_mark_x INT64 NULLABLE
popularity_index INT64 NULLABLE
training_index FLOAT64 NULLABLE
stable_index FLOAT64 NULLABLE
training_arrow_code INT64 NULLABLE
stable_eval_code INT64 NULLABLE
jockey_expected_win_rate FLOAT64 NULLABLE
surge_index INT64 NULLABLE
hoof_code INT64 NULLABLE
heavy_aptitude_code INT64 NULLABLE
class_code INT64 NULLABLE
blinker STRING NULLABLE
jockey_name STRING NULLABLE
weight_carried FLOAT64 NULLABLE
apprentice_class INT64 NULLABLE
trainer_name STRING NULLABLE
trainer_affiliation STRING NULLABLE
prev_race_key_1 STRING NULLABLE
prev_race_key_2 STRING NULLABLE
prev_race_key_3 STRING NULLABLE
prev_race_key_4 STRING NULLABLE
prev_race_key_5 STRING NULLABLE
bracket_number INT64 NULLABLE
overall_mark INT64 NULLABLE
idm_mark INT64 NULLABLE
info_mark INT64 NULLABLE
jockey_mark INT64 NULLABLE
stable_mark INT64 NULLABLE
training_mark INT64 NULLABLE
surge_mark INT64 NULLABLE
turf_aptitude STRING NULLABLE
dirt_aptitude STRING NULLABLE
jockey_code STRING NULLABLE
trainer_code STRING NULLABLE
prize_money INT64 NULLABLE
earned_prize INT64 NULLABLE
condition_class INT64 NULLABLE
ten_index FLOAT64 NULLABLE
pace_index FLOAT64 NULLABLE
agari_index FLOAT64 NULLABLE
position_index FLOAT64 NULLABLE
pace_forecast STRING NULLABLE
mid_position INT64 NULLABLE
mid_gap INT64 NULLABLE
mid_inside_outside INT64 NULLABLE
last_3f_position INT64 NULLABLE
last_3f_gap INT64 NULLABLE
last_3f_inside_outside INT64 NULLABLE
goal_position INT64 NULLABLE
goal_gap INT64 NULLABLE
goal_inside_outside INT64 NULLABLE
development_code STRING NULLABLE
distance_aptitude_2 INT64 NULLABLE
confirmed_weight INT64 NULLABLE
confirmed_weight_diff INT64 NULLABLE
cancel_flag INT64 NULLABLE
sex_code INT64 NULLABLE
owner_name STRING NULLABLE
owner_club_code INT64 NULLABLE
horse_symbol_code INT64 NULLABLE
surge_rank INT64 NULLABLE
ls_index_rank INT64 NULLABLE
ten_index_rank INT64 NULLABLE
pace_index_rank INT64 NULLABLE
agari_index_rank INT64 NULLABLE
position_index_rank INT64 NULLABLE
jockey_expected_win_single FLOAT64 NULLABLE
jockey_expected_top3 FLOAT64 NULLABLE
transport_class STRING NULLABLE
running_form STRING NULLABLE
body_type STRING NULLABLE
body_total_1 INT64 NULLABLE
body_total_2 INT64 NULLABLE
body_total_3 INT64 NULLABLE
horse_note_1 INT64 NULLABLE
horse_note_2 INT64 NULLABLE
horse_note_3 INT64 NULLABLE
start_index FLOAT64 NULLABLE
late_start_rate FLOAT64 NULLABLE
reference_prev_race STRING NULLABLE
reference_jockey_code STRING NULLABLE
big_ticket_index INT64 NULLABLE
big_ticket_mark INT64 NULLABLE
demotion_flag INT64 NULLABLE
surge_type STRING NULLABLE
rest_reason_code INT64 NULLABLE
flags STRING NULLABLE
stable_entry_race_count INT64 NULLABLE
stable_entry_date STRING NULLABLE
stable_entry_days_before INT64 NULLABLE
pasture STRING NULLABLE
pasture_rank STRING NULLABLE
stable_rank INT64 NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "race_results": """
race_id STRING REQUIRED
horse_number INT64 REQUIRED
horse_id STRING REQUIRED
race_date DATE NULLABLE
horse_name STRING NULLABLE
distance INT64 NULLABLE
course_type STRING NULLABLE
direction STRING NULLABLE
track_condition STRING NULLABLE
race_type STRING NULLABLE
race_condition STRING NULLABLE
grade STRING NULLABLE
race_name STRING NULLABLE
num_horses INT64 NULLABLE
finish_position INT64 NULLABLE
abnormal_code INT64 NULLABLE
finish_time FLOAT64 NULLABLE
weight_carried FLOAT64 NULLABLE
jockey_name STRING NULLABLE
trainer_name STRING NULLABLE
win_odds FLOAT64 NULLABLE
win_popularity INT64 NULLABLE
idm FLOAT64 NULLABLE
raw_score FLOAT64 NULLABLE
track_bias FLOAT64 NULLABLE
pace FLOAT64 NULLABLE
late_start FLOAT64 NULLABLE
position_fault FLOAT64 NULLABLE
disadvantage FLOAT64 NULLABLE
front_disadvantage FLOAT64 NULLABLE
mid_disadvantage FLOAT64 NULLABLE
back_disadvantage FLOAT64 NULLABLE
race_score FLOAT64 NULLABLE
course_position INT64 NULLABLE
improvement_code INT64 NULLABLE
class_code INT64 NULLABLE
body_code INT64 NULLABLE
condition_code INT64 NULLABLE
race_pace STRING NULLABLE
horse_pace STRING NULLABLE
ten_index FLOAT64 NULLABLE
agari_index FLOAT64 NULLABLE
pace_index FLOAT64 NULLABLE
race_pace_index FLOAT64 NULLABLE
winner_name STRING NULLABLE
winner_time_diff FLOAT64 NULLABLE
front_3f_time FLOAT64 NULLABLE
last_3f_time FLOAT64 NULLABLE
remarks STRING NULLABLE
place_odds FLOAT64 NULLABLE
odds_10am_win FLOAT64 NULLABLE
odds_10am_place FLOAT64 NULLABLE
corner_position_1 INT64 NULLABLE
corner_position_2 INT64 NULLABLE
corner_position_3 INT64 NULLABLE
corner_position_4 INT64 NULLABLE
front_3f_lead_diff FLOAT64 NULLABLE
last_3f_lead_diff FLOAT64 NULLABLE
jockey_code STRING NULLABLE
trainer_code STRING NULLABLE
horse_weight INT64 NULLABLE
horse_weight_diff INT64 NULLABLE
weather_code INT64 NULLABLE
course_code STRING NULLABLE
race_running_style STRING NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "horse_master": """
horse_id STRING REQUIRED
horse_name STRING NULLABLE
sex_code INT64 NULLABLE
sex STRING NULLABLE
coat_color_code INT64 NULLABLE
horse_symbol_code INT64 NULLABLE
sire_name STRING NULLABLE
dam_name STRING NULLABLE
broodmare_sire_name STRING NULLABLE
birth_date DATE NULLABLE
sire_birth_year INT64 NULLABLE
dam_birth_year INT64 NULLABLE
broodmare_sire_birth_year INT64 NULLABLE
owner_name STRING NULLABLE
owner_club_code INT64 NULLABLE
breeder_name STRING NULLABLE
birthplace STRING NULLABLE
deletion_flag INT64 NULLABLE
data_date DATE NULLABLE
sire_line_code STRING NULLABLE
broodmare_sire_line_code STRING NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "horse_extended": """
race_id STRING REQUIRED
horse_number INT64 REQUIRED
race_date DATE NULLABLE
""" + "\n".join(f"{g}_{c} INT64 NULLABLE" for g in COUNTER_GROUPS for c in COUNTERS) + """
sire_turf_place_rate INT64 NULLABLE
sire_dirt_place_rate INT64 NULLABLE
sire_avg_place_distance INT64 NULLABLE
broodmare_sire_turf_place_rate INT64 NULLABLE
broodmare_sire_dirt_place_rate INT64 NULLABLE
broodmare_sire_avg_place_distance INT64 NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "venue_info": """
venue_id STRING REQUIRED
race_date DATE NULLABLE
venue_code STRING NULLABLE
venue_name STRING NULLABLE
year INT64 NULLABLE
kai INT64 NULLABLE
day STRING NULLABLE
region_code INT64 NULLABLE
day_of_week STRING NULLABLE
weather_code INT64 NULLABLE
turf_condition_code INT64 NULLABLE
turf_condition_inner INT64 NULLABLE
turf_condition_middle INT64 NULLABLE
turf_condition_outer INT64 NULLABLE
turf_bias INT64 NULLABLE
straight_bias_innermost INT64 NULLABLE
straight_bias_inner INT64 NULLABLE
straight_bias_middle INT64 NULLABLE
straight_bias_outer INT64 NULLABLE
straight_bias_outermost INT64 NULLABLE
dirt_condition_code INT64 NULLABLE
dirt_condition_inner INT64 NULLABLE
dirt_condition_middle INT64 NULLABLE
dirt_condition_outer INT64 NULLABLE
dirt_bias INT64 NULLABLE
data_category INT64 NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "pedigree": """
horse_id STRING REQUIRED
horse_name STRING NULLABLE
sire_id STRING NULLABLE
sire_name STRING NULLABLE
dam_id STRING NULLABLE
dam_name STRING NULLABLE
dam_sire_id STRING NULLABLE
dam_sire_name STRING NULLABLE
sire_line STRING NULLABLE
birth_year INT64 NULLABLE
sex STRING NULLABLE
coat_color STRING NULLABLE
breeder STRING NULLABLE
owner STRING NULLABLE
created_at TIMESTAMP NULLABLE
updated_at TIMESTAMP NULLABLE
""",
    "odds": """
race_id STRING REQUIRED
horse_id STRING REQUIRED
odds_type STRING REQUIRED
odds_value FLOAT64 NULLABLE
odds_timestamp TIMESTAMP REQUIRED
horse_number INT64 NULLABLE
created_at TIMESTAMP NULLABLE
""",
    "training_data": """
race_id STRING REQUIRED
horse_id STRING REQUIRED
race_date DATE REQUIRED
target_place BOOL NULLABLE
finish_position INT64 NULLABLE
venue_code STRING NULLABLE
race_number INT64 NULLABLE
course_type STRING NULLABLE
distance INT64 NULLABLE
track_condition STRING NULLABLE
num_horses INT64 NULLABLE
bracket_number INT64 NULLABLE
horse_number INT64 NULLABLE
weight INT64 NULLABLE
past_3_avg_position FLOAT64 NULLABLE
past_5_avg_position FLOAT64 NULLABLE
past_10_avg_position FLOAT64 NULLABLE
past_3_avg_last3f FLOAT64 NULLABLE
past_5_avg_last3f FLOAT64 NULLABLE
turf_win_rate FLOAT64 NULLABLE
dirt_win_rate FLOAT64 NULLABLE
distance_category_win_rate FLOAT64 NULLABLE
venue_win_rate FLOAT64 NULLABLE
heavy_track_win_rate FLOAT64 NULLABLE
jockey_id STRING NULLABLE
jockey_win_rate FLOAT64 NULLABLE
jockey_venue_win_rate FLOAT64 NULLABLE
trainer_id STRING NULLABLE
trainer_win_rate FLOAT64 NULLABLE
jockey_te_place FLOAT64 NULLABLE
trainer_te_place FLOAT64 NULLABLE
sire_te_place FLOAT64 NULLABLE
dam_sire_te_place FLOAT64 NULLABLE
weight_rank INT64 NULLABLE
ability_rank INT64 NULLABLE
last3f_rank INT64 NULLABLE
front_runner_count INT64 NULLABLE
expected_pace_score FLOAT64 NULLABLE
odds_yesterday FLOAT64 NULLABLE
odds_today FLOAT64 NULLABLE
created_at TIMESTAMP NULLABLE
""",
}


@dataclass(frozen=True)
class Table:
    """Where a table lives and how its files are laid out."""

    dataset: str
    key: tuple[str, ...]
    partition: str | None = None
    sort: tuple[str, ...] = ()
    partition_expr: str | None = None  # derives the partition column when it is not stored


# Upsert keys, day partitions and clustering columns. The
# clustering of horse_results uses the code columns the table really has.
TABLES = {
    "race_info": Table("raw", ("race_id",), "race_date", ("venue_code", "race_number")),
    "horse_results": Table("raw", ("race_id", "horse_number"), None,
                           ("horse_id", "jockey_code", "trainer_code")),
    "race_results": Table("raw", ("race_id", "horse_number"), "race_date"),
    "horse_master": Table("raw", ("horse_id",)),
    "horse_extended": Table("raw", ("race_id", "horse_number"), "race_date"),
    "venue_info": Table("raw", ("venue_id",), "race_date"),
    "pedigree": Table("raw", ("horse_id",), None, ("sire_id", "dam_sire_id")),
    "odds": Table("raw", ("race_id", "horse_id", "odds_type", "odds_timestamp"), "odds_date",
                  ("race_id", "horse_id", "odds_type"), "cast(odds_timestamp AS date)"),
    "training_data": Table("features", ("race_id", "horse_id"), "race_date",
                           ("venue_code", "horse_id")),
}
DATASETS = ("raw", "features", "predictions", "backtests")


def table_schema(name: str) -> T.StructType:
    return struct_from_spec(_spec(TABLE_SPECS[name]))


def required_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not f.nullable]
