"""The positions written out for SQL stand on their own: a wrong slice, kind or guard in a layout shows."""

import dataclasses

import pytest

from furlong.plans import queries_records as records
from furlong.sources.layouts import LAYOUTS
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def difference(spark, kind):
    name = {"KAA": "whole_meetings", "UKC": "whole_horses"}[kind]
    return compare(spark, duck(SF), SF, name, {name: lambda s, sf: records.record_rows(s, sf, kind)}, {name: records.record_sql(kind)})


def changed(kind, name, **values):
    layout = LAYOUTS[kind]
    return dataclasses.replace(layout, fields=[dataclasses.replace(f, **values) if f.name == name else f for f in layout.fields])


@pytest.mark.parametrize("kind, name, values", [
    ("KAA", "turf_bias", {"start": 25}), ("KAA", "weather_code", {"start": 19, "end": 20}), ("UKC", "owner_club_code", {"end": 126}),
    ("UKC", "sire_name", {"start": 32}), ("UKC", "deletion_flag", {"min_length": 1000})])
def test_a_wrong_layout_is_noticed(spark, monkeypatch, kind, name, values):
    monkeypatch.setitem(LAYOUTS, kind, changed(kind, name, **values))
    assert difference(spark, kind)


def test_the_layouts_as_they_are(spark):
    assert not difference(spark, "KAA") and not difference(spark, "UKC")


def test_sql_has_every_field_of_every_layout():
    for kind, positions in records.POSITIONS.items():
        assert set(records.fields_sql(positions)) == {f.name for f in LAYOUTS[kind].fields}, kind
