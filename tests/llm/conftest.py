import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "row string, h long, id_key string, fp long, score double, copies int, part int, covered string, left string, n_hit long, word string"
PAGES = "page_id long, url string, html string"

PASSAGE = (
    "The harbour wall was built in two summers. Every stone came by barge from the northern quarry, and the masons slept in tents. "
    "When the first storm broke, nothing moved. The town kept the tools in a glass case. Visitors still ask for the oldest hammer. "
    "Nobody knows who carved the small fish near the gate."
)
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def odd_texts():
    """(doc_id, text, source): nulls, empty, blank, ties, repeated rows, a very long text."""
    long_text = " ".join(f"word{i % 977}x{i}." for i in range(40_000))
    return [
        (1, "One plain sentence about the sea. " + PASSAGE + " An ending of its own here.", "a"),
        (2, "Something else entirely at first. " + PASSAGE + " Then it stops.", "a"),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \t\n ", None),
        (6, "one two", "b"),
        (7, "one two", "b"),
        (7, "one two", "b"),
        (7, "another text under the same number", "b"),
        (None, "a row without a number", "c"),
        (None, "a row without a number", "c"),
        (None, None, None),
        (8, long_text, "a"),
        (9, "Intro words. " + ITEM.upper() + " and more words follow here", "c"),
        (10, "MIT License. Apache License; cc by\ncc-by GNU General Public License", "c"),
        (11, "漢字" * 200 + " ÉCOLE école 😀 \x00 end", ""),
        (12, "To To To To " * 200, "a"),
        (13, "pi rho", "c"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", s, None if t is None else len(t), *[None] * len(CLASH.split(","))) for i, t, s in odd_texts()]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def items(spark):
    rows = [(1, ITEM), (2, "pi rho"), (2, "pi rho"), (3, None), (4, ""), (None, "word5x5 word6x6 word7x7"), (5, "the the the the")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="session")
def odd_pages(spark):
    body = "<html><body><nav>menu</nav><article><h1>T {0}</h1><p>Body &amp; text {0}<p>more\n words</article><div class=ad>Buy</div></body></html>"
    rows = [
        (1, "https://www.Example.com/en/5?x#y", body.format(1)),
        (2, "http://a.b.net/es/7.html", body.format(2)),
        (2, "http://a.b.net/es/7.html", body.format(2)),
        (3, "http://a.b.org/fr/1", ""),
        (4, None, body.format(4)),
        (5, "no scheme", None),
        (None, "ftp://net/fr/", "<p>a<br>b<script>1<2</script><!-- c --><p>d"),
        (6, "https://example.com", "plain &lt;text&gt;"),
        (7, "https://example.com/en/", "<div>" * 2000 + "deep" + "</div>" * 2000),
        (8, "x://notexample.com/en/", "<article></article><div class='ad'>Buy</div>"),
        (9, "http://a.b.org/fr/1", "<p>" + "long " * 50_000),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"{PAGES}, host string, rule int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (7, 1, None), (7, 0, 1), (12, 0, 0), (None, 1, 1), (5, None, 1), (10, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """Nulls, NaN, infinity, another length, repeated rows, ties, zero vectors, null ids and labels; 40 plain rows."""
    rng = random.Random(4)
    draw = lambda: [rng.gauss(0, 0.2) for _ in range(6)]
    twice = draw()
    rows = [(k, draw(), k % 4) for k in range(100, 140)]
    rows += [(0, twice, 1), (0, twice, 1), (50, twice, 1), (51, twice, 1), (200, twice, 2), (250, [0.0] * 6, 1), (251, [0.0] * 6, 2)]
    rows += [(150, draw(), 3), (350, draw(), 0), (350, draw(), 1), (None, draw(), 1), (None, draw(), 2), (400, draw(), None)]
    rows += [(450, None, 1), (500, [None] + [0.1] * 5, 1), (550, [float("nan")] + [0.1] * 5, 1), (600, [float("-inf")] + [0.1] * 5, 2)]
    rows += [(650, [0.1] * 4, 1), (700, [], 1)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, vector string, n int")


def stored(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory, odd_docs, items, odd_pages, odd_labels, odd_vectors):
    folder = tmp_path_factory.mktemp("odd")
    return stored(folder, documents=odd_docs, benchmark=items, pages=odd_pages, labels=odd_labels, embeddings=odd_vectors)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, odd_docs, items, odd_pages, odd_labels, odd_vectors):
    folder = tmp_path_factory.mktemp("empty")
    tables = {"documents": odd_docs, "benchmark": items, "pages": odd_pages, "labels": odd_labels, "embeddings": odd_vectors}
    return stored(folder, **{name: df.limit(0) for name, df in tables.items()})
