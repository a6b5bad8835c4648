"""Rows of every query, the flagship, and operators without SQL."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import feeds
from corpusloom.plans import catalog, feed_catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(feed_catalog.QUERIES))
def test_query_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_flagship_has_rows(spark, sf):
    assert catalog.flagship(spark, f"/root/testdata/sf{sf}").count() > 10


def test_coverage_percentiles(spark):
    rng = random.Random(2)
    for size in (1, 2, 9, 10, 37, 400):
        x = sorted(round(rng.random(), 2) for _ in range(size))
        got = feeds.coverage_percentiles(spark.createDataFrame([(v,) for v in x], "confidence double")).first()
        middle = (x[(size - 1) // 2] + x[size // 2]) / 2
        assert abs(got["mean"] - sum(x) / size) < 1e-3 and abs(got["median"] - middle) < 1e-3 and got["p10"] == x[max(0, size // 10 - 1)]


@pytest.mark.parametrize(
    "url,reason",
    [
        ("https://x.com/a", "non-government domain: x.com"),
        ("https://www.senate.gov/press-releases", "listing page URL, not a detail page"),
        ("https://www.senate.gov/press-releases/#x", "listing page with anchor"),
        ("https://www.senate.gov/press-releases/a", None),
        ("https://senate.gov.twitter.com/a", "social media: senate.gov.twitter.com"),
    ],
)
def test_bad_url_reason(spark, url, reason):
    assert spark.range(1).select(feeds.bad_url_reason(F.lit(url)).alias("x")).first().x == reason
