"""Titles, names, site signals, records and audits on literal cases, and the forms that SQL does not state."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.operators import recon, terms
from corpusloom.sources import records, sites
from corpusloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "title,want",
    [
        ("THE PLAN OF NASA FOR A HOUSE", "The PLAN of NASA for a House"),
        ("Quiet &amp; short &#8217;&x2014;", "Quiet & short ’—"),
        ("&#x110000; stays", "&#x110000; stays"),
        ("1234", "1234"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_title(spark, title, want):
    assert one(spark, N.normalize_title(F.col("t")), t=title) == want


@pytest.mark.parametrize("name,key", [("Elizabeth A. Warren", "warren-elizabeth"), ("Bob Stone Jr.", "stone-bob"), ("Solo", "solo")])
def test_entity_key(spark, name, key):
    assert one(spark, N.entity_key(F.col("n")), n=name) == key


def test_name_exclusions_go_both_ways(spark):
    found = one(spark, N.name_exclusions(F.col("n"), F.col("i")), n="Charles Able", i="able-ted")
    assert {"charles", "chuck", "charlie", "able", "edward", "theodore"} <= set(found) and "ed" not in found


@pytest.mark.parametrize(
    "html,platform,family",
    [
        ('<a href="https://public.govdelivery.com/accounts/ABC/subscriber/new">', "govdelivery", "unknown"),
        ('<link href="/wp-content/x.css"><a href="https://x.list-manage.com/s">', "mailchimp", "wordpress"),
        ('<form>Newsletter <input type="email"></form><div class="views-row">', "custom_form", "drupal"),
        ('<body><div id="root"></div></body>', "unknown", "js-spa"),
        ("", "unknown", "unknown"),
    ],
)
def test_site_rules(spark, html, platform, family):
    assert one(spark, sites.email_platform(F.col("h")), h=html) == platform
    assert one(spark, sites.site_family(F.col("h")), h=html) == family


@pytest.mark.parametrize("html,want", [("<p>Page 1 of 25</p>", (25, "pages")), ("<p>1-10 of 234 results</p>", (234, "items")), ('<a href="/n/page/3"><a href="/n/page/12">', (12, "pages")), ('<a href="?offset=40">', (40, "offset")), ("<p>x</p>", (None, None))])
def test_pagination(spark, html, want):
    assert tuple(one(spark, sites.pagination(F.col("h")), h=html)) == want


def test_sitemap_index_is_followed_to_its_depth(spark):
    chain = [(f"i{k}.xml", f"<sitemapindex><sitemap><loc>i{k + 1}.xml</loc></sitemap><sitemap><loc>u{k}.xml</loc></sitemap><sitemap><loc>x.html</loc></sitemap></sitemapindex>") for k in range(6)]
    leaves = [(f"u{k}.xml", f"<urlset><url><loc>https://h/{k}</loc></url></urlset>") for k in range(6)]
    maps = spark.createDataFrame(chain + leaves, "map_url string, xml string")
    found = sites.sitemap_urls(maps, spark.createDataFrame([("i0.xml",)], "map_url string"))
    assert sorted(r.url for r in found.collect()) == ["https://h/0", "https://h/1", "https://h/2"]


def test_clean_texts(spark):
    long = "this is a line of many words that is no fragment"
    rows = [(1, f"Word\n\nby\n\nword\n{long}\n\n\n\nA bit\n{long}  end\n\n- 30 -"), (2, None), (3, ""), (1, "x")]
    found = sorted(tuple(r) for r in recon.clean_texts(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert found == sorted([(1, f"Word by word\n{long}\n\nA bit\n{long} end"), (1, "x"), (2, ""), (3, "")])


def test_cms_records_in_wrapped_json(spark):
    body = "<b>x</b>" + json.dumps([{"link": "https://h.org/a/", "date": "2025-03-01T10:00:00", "title": {"rendered": "A <i>title</i>"}, "content": {"rendered": "<p>b</p>"}}, {"link": "https://h.org/b", "date": "2025-03-01T10:00:00", "title": {"rendered": "No"}}]) + "<!-- end -->"
    bodies = spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "body_id int, body string")
    assert [(r.url, r.title, r.body_text) for r in sites.cms_records(bodies, "2025-01-01").collect()] == [("https://h.org/a", "A title", "b")]


@pytest.mark.parametrize(
    "html,want",
    [
        (f'<body><div class="nav">no</div><div class="entry-content"><p>{"word " * 30}</p><br>end</div></body>', ("word " * 30).strip() + " end"),
        (f'<main><div>short</div><section><p>{"a " * 60}<p>{"b " * 10}</section></main>', ("a " * 60).strip() + "\n" + ("b " * 10).strip()),
        ("<body><div><p>short</p></div></body>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_body_of(html, want):
    assert records.body_of(html) == want


def test_contacts_and_their_ranks(spark):
    rows = [(1, k, "text\nContact: Ann Lee, Director\n(202) 555-0100 a@x.org") for k in range(2)] + [(1, 3, "Contact: Bea Stone\n"), (1, 4, "Contact: Press Office\n"), (1, 5, None)]
    found = records.ranked_contacts(records.contacts(spark.createDataFrame(rows, "member_id int, release_id int, body_text string"))).orderBy("rank").collect()
    assert [tuple(r)[:4] for r in found] == [(1, 1, "Ann Lee", 2), (1, 2, "Bea Stone", 1)]
    assert (found[0].title, found[0].email, found[0].phone) == ("Director", "a@x.org", "(202) 555-0100")


def test_headlines_mark_every_window(spark):
    rows = terms.headlines(Tables.of(spark, SF), ["thble"]).collect()
    assert rows and all("<mark>" in r.snippet and len(r.snippet.split(" … ")) <= 2 for r in rows)


def test_quarantine_keeps_every_row(spark, tmp_path):
    rows = records.with_reason(spark.range(10), {"odd": F.col("id") % 2 == 1, "big": F.col("id") > 5})
    records.write_quarantine(rows, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3
    assert {(r.reason, r["count"]) for r in spark.read.parquet(f"{tmp_path}/quarantine").groupBy("reason").count().collect()} == {("odd", 5), ("big", 2)}


def test_skipped_sections_and_labels_follow_the_whole_lists(spark):
    paths = ["/News/Photos/", "/videos/", "/x/in-the-news/", "/legislation/", "/ES/noticias/", "/tag/a/", "/2025/03/", "/2025/", "/news/2023/", "/privacy-policy/", "/a-success-stories/"]
    kept = ["/news/2025/", "/op-eds/", "/press/"]
    urls = spark.createDataFrame([(p, None, f"https://h{p}{i}") for p in paths + kept for i in range(3)], "section string, lastmod string, url string")
    none = spark.createDataFrame([], "section string")
    found = recon.source_audit(urls, none, spark.createDataFrame([(p, 200) for p in paths + kept], "section string, status int"), 3)
    assert sorted(r.section for r in found.collect()) == sorted(kept)
    for label, want in [("Blog", "blog"), ("Blog: in the news", None), ("ICYMI podcast", None), ("Share your opinion blog", None), ("Press clips newsletter", None), ("Casework", None), ("Op-Eds", "op_ed")]:
        assert one(spark, recon.stream_of_label(F.col("label")), label=label) == want, label


def test_sitemap_index_is_read_whole(spark):
    leaf = lambda i: (f"s{i}.xml", f"<urlset><url><loc>https://h/{i}</loc></url></urlset>")
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>s{i}.xml</loc></sitemap>" for i in range(40)) + "</sitemapindex>"
    maps = spark.createDataFrame([("i.xml", index), *map(leaf, range(40))], "map_url string, xml string")
    roots = spark.createDataFrame([("i.xml",)], "map_url string")
    assert {r.url for r in sites.sitemap_urls(maps, roots).collect()} == {f"https://h/{i}" for i in range(40)}
    assert {r.url for r in sites.sitemap_urls(maps, roots, 30).collect()} == {f"https://h/{i}" for i in range(30)}


def test_best_feeds(spark):
    import datetime

    day = lambda k: datetime.datetime(2026, 4, 1) - datetime.timedelta(days=k)
    good = [(1, 10, k, f"A title of some length {k}", day(k), "<p>" + "x" * 300, 200) for k in range(12)]
    worse = [(1, 11, k, "Podcast", None, None, None) for k in range(11)]
    none = [(2, 20, 0, None, None, None, 404)]
    rows = spark.createDataFrame(good + worse + none, "member_id long, feed_id long, pos int, title string, published_at timestamp_ntz, body string, link_status int")
    got = {r.member_id: r for r in sites.best_feeds(rows, "2026-04-26").collect()}
    assert (got[1].feed_id, got[1].eligible, got[1].reasons, got[1].span_days, got[1].stale_days, got[1].mean_body, got[1].full_bodies) == (10, True, [], 11, 25, 300, True)
    assert got[2].reasons == ["few items", "undated items", "no dates", "short titles", "dead links"] and not got[2].eligible
    only = {r.member_id: r.reasons for r in sites.best_feeds(rows.where("feed_id = 11"), "2026-04-26").collect()}
    assert only == {1: ["undated items", "no dates", "other titles", "no links checked"]}
    assert sites.best_feeds(rows.where("false"), "2026-04-26").count() == 0
