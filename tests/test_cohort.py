from datetime import date, datetime

import pytest

from tidemark.operators.cohort import build_cohort, cohort_profile, custom_filter, select_cohort
from tests.helpers import T0, US, h, person, sources, stay


def build(spark, stays, persons, **kw):
    src = sources(spark, stays=stays, persons=persons)
    return build_cohort(src.stays, src.persons, **kw)


def test_age_bounds(spark):
    ages = {1: 17, 2: 18, 3: 110, 4: 111}
    out = build(spark, [stay(i, i) for i in ages], [person(i, a) for i, a in ages.items()])
    assert sorted(r.stay_id for r in out.collect()) == [2, 3]
    # age moves with the year of the visit
    out = build(spark, [stay(1, 1)], [person(1, 10, 2016)])
    assert out.first().age_at_ed == 18


def test_times_and_death(spark):
    stays = [
        stay(1, 1, outtime=T0), stay(2, 1, outtime=T0 + US), stay(3, 1, intime=None, outtime=T0), {**stay(4, 1), "outtime": None},
        stay(5, 2), stay(6, 3), stay(7, 4), stay(8, 5, hadm_id=None),
        stay(9, 2, intime=datetime(2024, 1, 10)),
    ]
    persons = [person(1), person(2, dod=date(2024, 1, 10)), person(3, dod=date(2024, 1, 9)), person(4, dod=date(2024, 1, 11)), person(5)]
    out = {r.stay_id: r for r in build(spark, stays, persons).collect()}
    # the day of death only counts as alive at midnight
    assert sorted(out) == [2, 7, 8, 9]
    assert out[8].was_admitted == 0 and out[7].was_admitted == 1
    assert out[7].ed_los_hours == 12.0


def test_presets_and_custom_filter(spark):
    out = build(spark, [stay(1, 1), stay(2, 2, hadm_id=None)], [person(1, 70), person(2, 30)])
    ids = lambda df: sorted(r.stay_id for r in df.collect())
    assert ids(select_cohort(out, "admitted")) == [1]
    assert ids(select_cohort(out, "not_admitted")) == [2]
    assert ids(select_cohort(out, "all", " where b.age_at_ed >= 65 OR gender = 'X'")) == [1]
    assert custom_filter("  ") is None
    with pytest.raises(ValueError):
        custom_filter("stay_id IN (SELECT 1)")
    with pytest.raises(ValueError):
        select_cohort(out, "everyone")


def test_profile(spark):
    r = cohort_profile(build(spark, [stay(1, 1, outtime=h(0.5)), stay(2, 1, hadm_id=None, outtime=h(49))], [person(1, gender="M")])).first()
    assert (r.total_visits, r.unique_patients, r.unique_admissions, r.pct_male, r.n_short_stays, r.n_long_stays) == (2, 1, 1, 1.0, 1, 1)


def test_filter_leaves_literals_alone(spark):
    df = spark.createDataFrame([(1, "b.x over"), (2, "x over")], "stay_id int, note string")
    assert [r.stay_id for r in df.where(custom_filter("b.note = 'b.x over'")).collect()] == [1]
    assert df.where(custom_filter("note LIKE '%over%' AND f.stay_id > 0")).count() == 2
