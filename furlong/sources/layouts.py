"""Record layouts as data.

Each line of a layout is ``name start end kind``: a 0-based half-open slice of
characters and how to read it. A kind may carry ``?`` (present only when the
line is longer than the slice's end) or ``@n`` (present only when the line has
at least ``n`` characters).

Kinds: ``int`` ``dbl`` ``date`` ``str`` (stripped) ``opt`` (stripped, blank is
NULL) ``wide`` (opt without full-width spaces) ``tenths`` ``change`` (signed
weight change) ``raw`` (unstripped).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions import fields as fx

READERS = {
    "int": fx.to_int,
    "dbl": fx.to_float,
    "date": fx.to_ymd,
    "str": fx.strip,
    "opt": lambda c: fx.blank_to_null(fx.strip(c)),
    "wide": lambda c: fx.blank_to_null(fx.wide(c)),
    "tenths": fx.to_tenths,
    "change": fx.signed_change,
    "raw": lambda c: c,
}
@dataclass(frozen=True)
class Field:
    name: str
    start: int
    end: int
    kind: str
    min_length: int | None = None

    def column(self, segment: Column, offset: int, length: Column) -> Column:
        """Value of the field, cut from a segment of the line that starts at ``offset``."""
        value = READERS[self.kind](fx.chars(segment, self.start - offset, self.end - offset))
        if self.min_length is not None:
            value = F.when(length >= self.min_length, value)
        return value.alias(self.name)


SEGMENT = 32


def read_fields(lines, fields, keep=()):
    """Apply a layout to the ``line`` column.

    Finding a character position walks the line from its start, so the line is
    first cut into overlapping segments and each field is taken from the
    segment it starts in. Segments and length are computed once per line.
    """
    at = {f.name: f.start // SEGMENT * SEGMENT for f in fields}
    reach = {}
    for f in fields:
        reach[at[f.name]] = max(reach.get(at[f.name], 0), f.end)
    prepared = lines.withColumns(
        {f"_s{o}": fx.chars(F.col("line"), o, end) for o, end in reach.items()} | {"_length": F.length("line")})
    return prepared.select(*keep, *[
        f.column(F.col(f"_s{at[f.name]}"), at[f.name], F.col("_length")) for f in fields])


def read_layout(text: str) -> list[Field]:
    out = []
    for row in text.strip().splitlines():
        name, start, end, kind = row.split()
        floor = None
        if kind.endswith("?"):
            kind, floor = kind[:-1], int(end) + 1
        elif "@" in kind:
            kind, at = kind.split("@")
            floor = int(at)
        out.append(Field(name, int(start), int(end), kind, floor))
    return out


# Slice positions of the published record formats.
PROGRAMME = """
race_id 0 8 str
race_date 8 16 date
distance 20 24 int
_surface 24 25 raw
_direction 25 26 raw
age_condition 27 29 str
_condition 29 31 str
sex_condition 31 34 str
_grade 35 36 str
race_name 36 86 str
"""

ENTRY = """
race_id 0 8 str
horse_number 8 10 int
horse_id 10 18 str
horse_name 18 36 wide
idm 36 41 dbl
jockey_index 41 46 dbl
info_index 46 51 dbl
total_index 67 72 dbl
running_style 73 74 int
distance_aptitude 76 77 int
base_odds 78 83 dbl
base_popularity 83 85 int
base_place_odds 86 91 dbl
base_place_popularity 89 91 int
specific_mark_circle 93 94 int?
specific_mark_circle2 94 95 int?
specific_mark_triangle 95 96 int?
specific_mark_triangle2 96 97 int?
specific_mark_x 97 98 int?
total_mark_circle 98 99 int?
total_mark_circle2 99 100 int?
total_mark_triangle 100 101 int?
total_mark_triangle2 101 102 int?
total_mark_x 102 103 int?
popularity_index 103 106 int?
training_index 106 111 dbl?
stable_index 111 116 dbl?
training_arrow_code 116 117 int?
stable_eval_code 117 118 int?
jockey_expected_win_rate 118 123 dbl?
surge_index 123 126 int?
hoof_code 126 128 int?
heavy_aptitude_code 128 129 int?
class_code 129 131 int?
blinker 131 132 opt?
jockey_name 153 159 wide?
weight_carried 159 162 tenths?
apprentice_class 162 163 int?
trainer_name 163 169 wide?
trainer_affiliation 169 171 wide?
prev_race_key_1 171 187 opt?
prev_race_key_2 187 203 opt?
prev_race_key_3 203 219 opt?
prev_race_key_4 219 235 opt?
prev_race_key_5 235 251 opt?
bracket_number 251 252 int?
overall_mark 286 287 int?
idm_mark 287 288 int?
info_mark 288 289 int?
jockey_mark 289 290 int?
stable_mark 290 291 int?
training_mark 291 292 int?
surge_mark 292 293 int?
turf_aptitude 293 294 opt?
dirt_aptitude 294 295 opt?
jockey_code 295 300 opt?
trainer_code 300 305 opt?
prize_money 305 310 int?
earned_prize 310 315 int?
condition_class 315 316 int?
ten_index 326 331 dbl?
pace_index 331 336 dbl?
agari_index 336 341 dbl?
position_index 342 346 dbl?
pace_forecast 346 347 opt?
mid_position 348 350 int?
mid_gap 350 352 int?
mid_inside_outside 352 353 int?
last_3f_position 353 355 int?
last_3f_gap 355 357 int?
last_3f_inside_outside 357 358 int?
goal_position 358 360 int?
goal_gap 360 362 int?
goal_inside_outside 362 363 int?
development_code 363 364 opt?
confirmed_weight 373 376 int?
confirmed_weight_diff 376 379 int?
sex_code 363 364 int?
owner_name 379 399 wide?
"""

RESULT = """
race_id 0 8 str
horse_number 8 10 int
horse_id 10 18 str
race_date 18 26 date
horse_name 26 44 wide
distance 44 48 int
_surface 48 49 raw
_direction 49 50 raw
_going 51 53 raw
race_type 53 55 opt
race_condition 55 57 opt
_grade 61 62 str
race_name 62 87 wide
num_horses 87 89 int
finish_position 93 95 int
abnormal_code 95 96 int
finish_time 96 100 tenths
weight_carried 100 103 tenths
jockey_name 103 109 wide
trainer_name 109 115 wide
win_odds 115 121 dbl
win_popularity 121 123 int
idm 123 126 dbl
raw_score 126 129 dbl
track_bias 129 132 dbl
pace 132 135 dbl
late_start 135 138 dbl
position_fault 138 141 dbl
disadvantage 141 144 dbl
front_disadvantage 144 147 dbl
mid_disadvantage 147 150 dbl
back_disadvantage 150 153 dbl
race_score 153 156 dbl
course_position 156 157 int
improvement_code 157 158 int
class_code 158 160 int
body_code 160 161 int
condition_code 161 162 int
race_pace 162 163 opt?
horse_pace 163 164 opt?
ten_index 164 169 dbl?
agari_index 169 174 dbl?
pace_index 174 179 dbl?
race_pace_index 179 184 dbl?
winner_name 184 190 wide?
winner_time_diff 190 193 tenths?
front_3f_time 193 196 tenths?
last_3f_time 196 199 tenths?
remarks 199 211 wide?
odds_10am_win 219 225 dbl@260
odds_10am_place 225 231 dbl@260
horse_weight 261 264 int@270
horse_weight_diff 264 267 change@270
weather_code 267 268 int@270
course_code 268 269 opt@270
race_running_style 269 270 opt@270
"""

HORSE = """
horse_id 0 8 str
horse_name 8 26 wide
sex_code 26 27 int
_sex 26 27 raw
coat_color_code 27 29 int
horse_symbol_code 29 31 int
sire_name 31 49 wide
dam_name 49 67 wide
broodmare_sire_name 67 85 wide
birth_date 85 93 date
sire_birth_year 93 97 int
dam_birth_year 97 101 int
broodmare_sire_birth_year 101 105 int
owner_name 105 125 wide?
owner_club_code 125 127 int?
breeder_name 127 147 wide?
birthplace 147 151 wide?
deletion_flag 151 152 int?
data_date 152 160 date?
sire_line_code 160 164 opt?
broodmare_sire_line_code 164 168 opt?
"""

MEETING = """
venue_code 0 2 str
_year 2 4 str
kai 4 5 int
day 5 6 str
race_date 6 14 date
region_code 14 15 int
day_of_week 15 16 opt
_name 16 18 wide
weather_code 18 19 int
turf_condition_code 19 21 int
turf_condition_inner 21 22 int
turf_condition_middle 22 23 int
turf_condition_outer 23 24 int
turf_bias 24 27 int
straight_bias_innermost 27 29 int
straight_bias_inner 29 31 int
straight_bias_middle 31 33 int
straight_bias_outer 33 35 int
straight_bias_outermost 35 37 int
dirt_condition_code 37 39 int
dirt_condition_inner 39 40 int
dirt_condition_middle 40 41 int
dirt_condition_outer 41 42 int
dirt_bias 42 45 int
data_category 45 46 int@46
"""

# The 23 counter groups of a condition record, in file order.
COUNTER_GROUPS = (
    "jra exchange other surface surface_dist track_dist rotation direction jockey good "
    "slightly_heavy heavy slow_pace medium_pace high_pace season bracket jockey_dist "
    "jockey_track_dist jockey_trainer jockey_owner jockey_blinker trainer_owner"
).split()
COUNTERS = ("win", "place", "show", "out")
SIRE_RATES = """
sire_turf_place_rate 286 289 int
sire_dirt_place_rate 289 292 int
sire_avg_place_distance 292 296 int
broodmare_sire_turf_place_rate 296 299 int
broodmare_sire_dirt_place_rate 299 302 int
broodmare_sire_avg_place_distance 302 306 int
"""


def record_layout() -> list[Field]:
    """Condition records: twelve characters per group, four three-digit counters each.

    A group cut short by the end of the line is NULL as a whole.
    """
    out = read_layout("race_id 0 8 str\nhorse_number 8 10 int")
    for g, group in enumerate(COUNTER_GROUPS):
        first = 10 + 12 * g
        out += [Field(f"{group}_{counter}", first + 3 * i, first + 3 * i + 3, "int", first + 12)
                for i, counter in enumerate(COUNTERS)]
    return out + read_layout(SIRE_RATES)


@dataclass(frozen=True)
class Layout:
    table: str
    min_length: int
    fields: list[Field]


def _layouts() -> dict[str, Layout]:
    # Shortest accepted line per record family.
    programme = Layout("race_info", 90, read_layout(PROGRAMME))
    entry = Layout("horse_results", 170, read_layout(ENTRY))
    return {
        "BAA": programme, "BAB": programme, "BAC": programme,
        "KYF": entry, "KYG": entry, "KYH": entry,
        "SEC": Layout("race_results", 200, read_layout(RESULT)),
        "UKC": Layout("horse_master", 160, read_layout(HORSE)),
        "KKA": Layout("horse_extended", 280, record_layout()),
        "KAA": Layout("venue_info", 40, read_layout(MEETING)),
    }


LAYOUTS = _layouts()
