"""The English analyser on the published sample vocabulary, and searches on postings against plain Python."""

import pytest

from corpusloom.functions.english import STOP, lexemes, stem
from corpusloom.operators import fulltext
from corpusloom.plans import catalog
from corpusloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"

STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol",
    "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol",
    "consonant": "conson", "consort": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "constable": "constabl",
    "constancy": "constanc", "constant": "constant", "knackeries": "knackeri", "knave": "knave", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "knee": "knee", "knees": "knee", "kneel": "kneel", "knife": "knife", "knightly": "knight", "knitted": "knit",
    "knitting": "knit", "knives": "knive", "knocker": "knocker", "knockers": "knocker", "knocking": "knock",
    "happy": "happi", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hoping": "hope", "hopping": "hop",
    "luxuriating": "luxuri", "dying": "die", "skies": "sky", "news": "news", "proceeds": "proceed", "say": "say", "by": "by", "cry": "cri",
    "generate": "generat", "generically": "generic", "youth": "youth", "boyish": "boyish", "covid19": "covid19",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stem(word):
    assert stem(word) == STEMS[word]


def test_lexemes():
    assert len(STOP) == len(set(STOP)) == 127
    assert lexemes("The Runner's running; RUNS in 2026") == {"runner": [1], "run": [3, 4], "2026": [6]}
    assert lexemes(None) == lexemes("") == lexemes("the of and") == {}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Written and read again, with a null, an empty and a very long text."""
    rows = [
        (1, "Clean water", "The senator announced funding for water projects"),
        (2, None, "Fund the project of waters. Projects funded."),
        (3, "", None),
        (4, "Projects", "of clean air, not of waters"),
        (5, "long", "word " * 20_000 + "funding for projects"),
        (6, "water", "projects of water"),
    ]
    path = str(tmp_path_factory.mktemp("postings"))
    fulltext.write_postings(spark.createDataFrame(rows, "release_id long, title string, body_text string"), path)
    return fulltext.read_postings(spark, path)


@pytest.mark.parametrize(
    "query,ids",
    [
        ({"all_of": ["Projects", "waters"]}, {1, 2, 4, 6}),
        ({"all_of": ["project"], "none_of": ["water"]}, {5}),
        ({"any_of": ["funds", "air"]}, {1, 2, 4, 5}),
        ({"phrase": "funding for projects"}, {2, 5}),  # "Fund the project" has the same stems at the same distance
        ({"phrase": "projects of water"}, {2, 6}),
        ({"all_of": ["the"]}, set()),
        ({}, set()),
        ({"none_of": ["water"]}, set()),
        ({"all_of": ["absent"]}, set()),
    ],
)
def test_search(index, query, ids):
    assert {r.release_id for r in fulltext.search(index, **query).collect()} == ids


def test_rank(index):
    assert [(r.release_id, r.hits) for r in fulltext.rank(index, "projects", 3).collect()] == [(2, 2), (1, 1), (4, 1)]


def test_a_search_pushes_its_terms_to_the_scan(index, capsys):
    fulltext.search(index, all_of=["water", "air"]).explain()
    pushed = capsys.readouterr().out.partition("PushedFilters: ")[2].partition("ReadSchema")[0]
    assert "In(term, [air,water])" in pushed or "In(term, [water,air])" in pushed


def test_postings_of_whole_tables(spark):
    """Every posting of the derived releases, against the analyser called on each text."""
    releases = Tables.of(spark, SF).releases
    got = {(r.term, r.release_id): r.positions for r in fulltext.postings(releases).collect()}
    want = {}
    for r in releases.select("release_id", "title", "body_text").collect():
        for term, at in lexemes(" ".join(x for x in (r.title, r.body_text) if x is not None)).items():
            want[term, r.release_id] = at
    assert got == want


def test_registered_searches(spark):
    """The registered queries, against the analyser called on each text."""
    rows = Tables.of(spark, SF).releases.select("release_id", "title", "body_text").collect()
    found = {r.release_id: lexemes(" ".join(x for x in (r.title, r.body_text) if x is not None)) for r in rows}
    a, b, c = (stem(w) for w in catalog.TERMS)
    ran = {n: catalog.queries()[n](spark, SF).collect() for n in ("d02_english_search_all", "d03_english_search_web", "d04_english_rank", "d08_english_term_counts")}
    assert {r.release_id for r in ran["d02_english_search_all"]} == {i for i, f in found.items() if a in f and b in f} != set()
    assert {r.release_id for r in ran["d03_english_search_web"]} == {i for i, f in found.items() if (a in f or b in f) and c not in f} != set()
    best = sorted(((-len(f[a]), i) for i, f in found.items() if a in f))[:25]
    assert [(-r.hits, r.release_id) for r in ran["d04_english_rank"]] == best != []
    counts = {}
    for f in found.values():
        for term, at in f.items():
            n, hits = counts.get(term, (0, 0))
            counts[term] = n + 1, hits + len(at)
    assert {r.term: (r.n_releases, r.n_hits) for r in ran["d08_english_term_counts"]} == counts
