from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from builders import D0, money  # noqa: E402
from seatwise.sources import contracts as C  # noqa: E402
from seatwise.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app_name="seatwise-tests")
    yield s


USER_DEFAULTS = dict(
    measurement_date=D0, account_id="ACC_1", user_id=1, segment="S", paid_seats=10,
    arr=money(1000), platform_arr=money(700), addon_a=money(0), addon_b=money(0), addon_c=money(0),
    addon_d=money(0), addon_e=money(0), is_active=True, did_search=False, did_create_list=False,
    did_pitch=False, did_view_report=False, did_view_dashboard=False, did_create_alert=False,
    next_renewal_date=dt.date(2024, 12, 31),
)

HEALTH_DEFAULTS = dict(
    measurement_date=D0, account_id="ACC_1", segment="S", health_score=Decimal("10.00"),
    feature_score=2.0, percent_days_active=Decimal("50.00"), feature_categories_used=2,
    net_positive_periods=0,
)

OBJECT_DEFAULTS = dict(
    measurement_date=D0, account_id="ACC_1", report_count=10, active_report_count=5,
    dashboard_count=10, active_dashboard_count=5, list_count=10, active_list_count=5,
)


def _frame(spark, schema, defaults, rows):
    data = []
    for r in rows:
        rec = dict(defaults)
        rec.update(r)
        for f in schema.fields:
            if f.dataType == C.MONEY and rec.get(f.name) is not None:
                rec[f.name] = money(rec[f.name])
        data.append(tuple(rec[f.name] for f in schema.fields))
    return spark.createDataFrame(data, schema)


@pytest.fixture
def user_days(spark):
    return lambda rows: _frame(spark, C.USER_DAYS, USER_DEFAULTS, rows)


@pytest.fixture
def health(spark):
    return lambda rows: _frame(spark, C.HEALTH, HEALTH_DEFAULTS, rows)


@pytest.fixture
def objects(spark):
    return lambda rows: _frame(spark, C.OBJECTS, OBJECT_DEFAULTS, rows)
