"""The drafts' side of the comparison is made once where both passes look equally far."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity


def test_one_side_for_both_passes(spark, monkeypatch):
    made, side = [], identity._side
    monkeypatch.setattr(identity, "_side", lambda offers, name, *days: made.append(name) or side(offers, name, *days))
    monkeypatch.setattr(identity, "_first_pass", lambda *_: (None,) * 4)

    def stop(*_):
        raise InterruptedError

    monkeypatch.setattr(identity, "_second_pass", stop)
    kind = "{} string, provider string, venue string, title string, kind string, low int, high int, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>"
    drafts, previous = (spark.createDataFrame([], kind.format(name)) for name in ("draft", "id"))
    day = lambda n: F.lit(date(2026, 3, n))
    for before, want in ((None, ["draft", "old"]), (day(20), ["draft", "old", "draft"])):
        made.clear()
        with pytest.raises(InterruptedError):
            identity.assign(drafts, previous, None, None, day(1), day(31), before)
        assert made == want
