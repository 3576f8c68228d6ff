"""What the registered ingest job is given."""

import contextlib

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from newsflow.catalog import cycles, queries
from newsflow.catalog.views import Views
from newsflow.operators import pages, select
from newsflow.params import Params


def test_ingest_cycle_drops_stale_rows_and_fills_descriptions(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(cycles, "_follow", lambda v, rows, start: (seen.update(rows=rows), start(rows)))
    monkeypatch.setattr(cycles, "ingest_stream", lambda source, path, inputs, state, params, **_: seen.update(inputs=inputs, params=params))
    with contextlib.suppress(Exception):  # the job is not run, so there is no pool
        queries.QUERIES["ingest_cycle"](Views(spark, "/root/testdata/sf0.001"))
    rows, params = seen["rows"].cache(), seen["params"]
    assert params.max_publish_age_hours == Params().max_publish_age_hours
    assert rows.filter("published_at > arrived_at").isEmpty()
    fresh = select.fresh_articles([rows], F.col("arrived_at"), params.max_publish_age_hours)
    whole, left = (dict(x.groupBy("landing").count().collect()) for x in (rows, fresh))
    assert len(whole) == cycles.LANDINGS and all(whole[n] / 2 < left[n] < whole[n] for n in whole)
    assert seen["inputs"].meta is not None
    filled = pages.description_backfill(rows, seen["inputs"].meta)
    blank = lambda x: x.filter("description = ''").count()
    assert filled.count() == rows.count() and blank(filled) < blank(rows)
