import datetime

import pytest

from phraseworks.llm.once import once
from tests.conftest import rows


@pytest.mark.parametrize("limit", [None, 0])
def test_one_row_a_key(spark, limit):
    day = [datetime.datetime(2024, 1, k) for k in (1, 2)]
    data = [(1, "old", day[0]), (1, "new", day[1]), (1, "never", None), (2, "same", day[0]), (2, "same", day[0]), (3, None, None), (None, "x", None), (None, "y", None)]
    df = spark.createDataFrame(data, "id bigint, text string, loaded_at timestamp")
    assert rows(once(df, "id", "loaded_at", limit).select("id", "text")) == sorted([(1, "new"), (2, "same"), (3, None), (None, "x"), (None, "y")], key=repr)
    assert once(df.where("false"), "id", "loaded_at", limit).count() == 0
