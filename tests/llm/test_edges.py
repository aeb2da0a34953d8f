"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakesift.llm import chat, decontamination, html_extract, license_scan, line_dedup, mixing, ngram_join, quality_rules, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_spans string, n_lines string, kept_ratio string, position string, epoch int, toxic_score string, node long, label long, key long, a long, b long, cluster long, region long, h long, slice int, n string"
LONG = "Some words make a sentence that goes on. " * 20000


@pytest.fixture(scope="module")
def docs(spark):
    base = [
        (1, "First document of all, with words.\nAnd a second line here.", "en", "s"), (1, "First document of all, with words.\nAnd a second line here.", "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (None, "An id is missing here, but the text is fine.", "en", None),
        (5, LONG, "en", "s"), (6, " \n\t ", "de", "t"), (7, "Short.", None, None), (8, "\x00 odd   characters \U0001f600 here.", "fr", "t"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "x", "x", "x", "x", 9, "x", 1, 1, 1, 1, 1, 1, 1, 1, 1, "x") for r in base], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "eight words that are only in the benchmark itself"), (2, None), (3, "two words")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda d, b: decontamination.decontaminate(d, b),
    "decontaminate by join": lambda d, b: decontamination.decontaminate(d, b, max_broadcast=0),
    "toxicity": lambda d, b: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.when(F.col("doc_id") == 7, 1).otherwise(0).alias("toxic")))),
    "ngram": lambda d, b: ngram_join.drop_copies(d),
    "ngram by join": lambda d, b: ngram_join.drop_copies(d, max_broadcast=-1),
    "quality": lambda d, b: quality_rules.clean_lines(d),
    "lines": lambda d, b: line_dedup.drop_lines(d, min_pages=1, min_on=1),
    "mix": lambda d, b: mixing.mix(d),
    "mix by join": lambda d, b: mixing.mix(d, max_broadcast=-1),
    "licence": lambda d, b: license_scan.scan(d),
    "html": lambda d, b: html_extract.extract_pages(d, "text"),
    "urls": lambda d, b: url_filters.filter_pages(d, "source", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(name, docs, bench):
    got = OPERATORS[name](docs, bench).collect()
    want = {"decontaminate": 10, "decontaminate by join": 10, "toxicity": 10, "ngram": 9, "ngram by join": 9, "quality": 6, "lines": 10, "licence": 0, "html": 10, "urls": 10}
    if name in want:
        assert len(got) == want[name]
    else:
        assert {r.doc_id for r in got} == {1, 2, 3, 5, 6, 7, 8, None}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty(name, docs, bench):
    assert OPERATORS[name](docs.limit(0), bench).count() == 0


def test_empty_benchmark(docs, bench):
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 10


def test_chat_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, "lost"), (1, 2, "robot", None), (None, 0, "assistant", ""), (2, 0, "user", LONG), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = df.withColumns({c: F.lit("x") for c in ("c", "turns", "roles", "texts", "chat", "n_lines", "n_turns")})
    assert sorted(map(str, chat.format_chats(more).collect())) == sorted(map(str, chat.format_chats(df).collect()))
    lost = spark.createDataFrame([(None, 0, "user", f"Line {k}.") for k in range(9)] + [(None, 0, "user", "Line 1.")], df.schema)
    assert [r.n_turns for r in chat.format_chats(df.unionByName(lost)).filter("conv_id is null and n_turns > 0").collect()] == [1] * 10
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, None} and got[2].chat.startswith("<|user|>\n") and got[3].n_turns == 0 == got[None].n_turns
    assert chat.format_chats(df.limit(0)).count() == 0


def test_stages(docs, spark, tmp_path, bench):
    """Every stage takes the odd table, and an empty one, and all but the last keep its columns."""
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns and out.dtypes == table.dtypes
            out.collect()


def test_any_number_of_closing_marks(spark):
    """The punctuation rule looks past all closing quotes and brackets of a line."""
    rows = [(1, "He said (and [they) wrote] it.)\"')]»”’)))))))))"), (2, "no end of a sentence\")))))))))))))"), (3, "\")]')")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.clean_lines(df).collect()] == [1]


def test_decontamination_of_odd_rows(spark):
    """A repeated row is treated each time; a text of which exactly half is a passage stays; case and marks don't matter; the item may fill a very long text."""
    item = "Eight plain words that stand in one test"
    half = "these other eight words are not in it"
    rows = [(1, f"{item}. {half}", "x"), (1, f"{item}. {half}", "x"), (2, item.upper(), "x"), (3, None, "x"), (4, "", "x"), (5, LONG + item + ", at the end. " + LONG, "x"), (None, f"Eight--plain WORDS, that (stand) in one test! {half} too", None), (7, f"{item} " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_cut string").withColumns({"h": F.lit(1), "gram": F.lit("g"), "item": F.lit("i")})
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    for limit in (64 << 20, 0):
        out = decontamination.decontaminate(df, bench, max_broadcast=limit)
        got = sorted((r.doc_id or 0, r.n_spans, r.n_tokens_cut, r.text if r.doc_id != 5 else len(r.text)) for r in out.collect())
        assert got == [(0, 1, 8, f"! {half} too"), (1, 1, 8, f". {half}"), (1, 1, 8, f". {half}"), (3, 0, 0, None), (4, 0, 0, ""), (5, 1, 8, 2 * len(LONG) + len(", at the end. "))]
        assert {"h", "gram", "item"} <= set(out.columns)


def test_licences_of_odd_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, LONG + "under the mit license, and once more UNDER THE MIT-LICENSE"), (5, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("license", "first_token", "n_places", "w", "n")})
    got = sorted((r.doc_id or 0, r.license, r.first_token, r.n_places) for r in license_scan.scan(df).collect())
    assert got == [(0, "MIT-notice", 8 * 20000, 2), (1, "MIT-notice", 1, 1), (1, "MIT-notice", 1, 1)]


def test_url_filter_of_odd_rows(spark):
    """Null and odd URLs stay, repeated rows stay as often, a host whose distrust equals the limit stays, clashing columns are overwritten."""
    bad = '<a href="http://spam.example/">x</a>'
    rows = [(1, "http://spam.example/", None), (2, "http://near.example/", bad + LONG), (2, "http://near.example/", bad + LONG), (3, None, bad), (4, "no url", bad), (5, "http://alone.example/", ""), (5, "http://alone.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "trust", "distrust", "rounds", "src", "dst", "side", "rank")})
    found = {r.host: r.distrust for r in url_filters.score_hosts(pages)[0].collect()}
    assert found == pytest.approx({"spam.example": 0.15, "near.example": 0.1275, "alone.example": 0.0})
    ids = lambda limit: sorted(r.page_id for r in url_filters.filter_pages(pages, max_distrust=limit).collect())
    assert ids(found["near.example"]) == [2, 2, 3, 4, 5, 5] and ids(0.1) == [3, 4, 5, 5]
    assert url_filters.filter_pages(pages).columns == ["page_id", "url", "html", "src", "dst", "side", "rank", "host", "trust", "distrust", "rounds"]


def test_ties_and_values(spark):
    """A score at its threshold is toxic; of equal ids one row stays; a line at the ratio stays, one above it goes."""
    rows = [(k, f"word{k % 3} and some more words here", "en") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    raw = {r.score for r in toxicity.raw_scores(df, model, []).filter("doc_id % 3 = 1").collect()}
    assert len(raw) == 1
    model.thresholds = {"en": raw.pop()}
    assert {r.doc_id % 3 for r in toxicity.score(df, model).filter("is_toxic").collect()} >= {1}
    same = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (None, "one two three four"), (0, None), (0, None), (2, "One, two, three, FOUR")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ngram_join.drop_copies(same).collect()) == [(0, None), (0, None), (1, "one two three four")]
    assert sorted((r._nj_id or 0, r._nj_group, r.n_docs, r.n_links) for r in ngram_join.groups(same).collect()) == [(0, 1, 4, 3), (1, 1, 4, 3), (1, 1, 4, 3), (2, 1, 4, 3)]
    pages = spark.createDataFrame([(k, "common\n" * (k < 5) + "often\n" * (k < 6) + f"own {k}", "s") for k in range(100)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in line_dedup.drop_lines(pages).collect()}
    assert got[0] == ("common\nown 0", 1) and got[5] == ("own 5", 1) and got[9] == ("own 9", 0)
