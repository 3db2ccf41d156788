"""Literal edge cases of scans, normalisers and de-duplication."""

import json

import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions.text import clean_name, sanitize_name, truncate, two_decimals
from trendloom.operators import bookkeeping as B
from trendloom.sources import landed, normalize, tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def raw(spark, ddl, *objects):
    lines = spark.createDataFrame([(json.dumps(o),) for o in objects], "value STRING")
    return lines.select(F.from_json("value", ddl).alias("r")).select("r.*")


def test_feed_entry_with_everything_missing_is_an_error(spark):
    entries = landed.feed_entry_fields(raw(spark, schemas.FEED_ENTRY, {"feed_url": "f", "pos": 1, "title": "x"}))
    row = one(normalize.normalize_feed_entry(entries))
    assert row.error and row.doc_text is None


def test_feed_entry_text_keeps_inner_newlines(spark):
    entry = {"link": "l", "title": "T", "summary": "S", "author": "A", "published": "P", "tags": [{"term": "x"}, {}]}
    row = one(normalize.normalize_feed_entry(landed.feed_entry_fields(raw(spark, schemas.FEED_ENTRY, entry))))
    assert row.doc_text == "T\n\nS\n\n\n\nAuthor: A\n\n\nPublished: P\n\n\nTags: x, "
    assert (row.item_id, row.dedupe_key) == ("l", "l")


def test_titles_are_clamped_to_512(spark):
    rows = raw(spark, schemas.ISSUE, {"number": 1, "html_url": "u", "title": "a" * 512}, {"number": 2, "html_url": "u", "title": "a" * 513})
    assert [len(r.doc_title) for r in normalize.normalize_issue(rows).collect()] == [512, 512]


def test_story_defaults(spark):
    row = one(normalize.normalize_story(raw(spark, schemas.STORY_ITEM, {"id": 5, "title": "t", "time": 0})))
    assert row.doc_url.endswith("item?id=5")
    assert row.doc_text == "t\n\n\nScore: 0\n\n\nComments: 0"
    row = one(normalize.normalize_story(raw(spark, schemas.STORY_ITEM, {"id": 5, "title": "t", "url": "http://a.b", "time": 1700000000})))
    assert "\n\nLink: http://a.b" in row.doc_text and row.doc_text.endswith("\nPublished: 2023-11-14T22:13:20+00:00")


def test_valid_stories_drops_jobs_deleted_and_dead(spark):
    rows = raw(spark, schemas.STORY_ITEM, {"id": 1, "type": "story"}, {"id": 2, "type": "job"}, {"id": 3, "type": "story", "dead": True},
               {"id": 4, "type": "story", "deleted": True})
    assert [r.id for r in landed.valid_stories(rows).collect()] == [1]


def test_commit_variants(spark):
    files = [{"filename": f"f{i}"} for i in range(11)]
    rows = raw(
        spark, schemas.COMMIT,
        {"owner": "o", "repo": "r", "sha": "abcdefghij", "files": files, "commit": {"author": {"email": "e@x"}}},
        {"owner": "o", "repo": "r", "sha": "", "commit": {"message": "m"}},
        {"owner": "o", "repo": "r", "sha": "123", "html_url": "u", "commit": {"message": "one\ntwo", "author": None}, "stats": {"total": 0}},
    )
    first, second, third = normalize.normalize_commit(rows).collect()
    assert first.doc_title == "Commit abcdefg: No message" and first.doc_url == "https://github.com/o/r/commit/abcdefghij"
    assert "\n\nAuthor: e@x" in first.doc_text and first.doc_text.endswith("f9\n\n (and 1 more)")
    assert second.error == "commit hash is missing"
    assert third.doc_title == "Commit 123: one" and third.doc_text == "Commit: 123\n\none\ntwo"


def test_release_names_and_types(spark):
    rows = raw(spark, schemas.RELEASE, {"id": 7, "html_url": "u", "prerelease": True, "draft": True}, {"id": 8, "html_url": "u", "tag_name": "v1", "draft": True})
    a, b = normalize.normalize_release(rows).collect()
    assert a.doc_title == "Release 7" and "Type: Pre-release" in a.doc_text
    assert b.doc_title == "v1" and "Type: Draft" in b.doc_text


def test_issue_scan_excludes_pull_requests(spark, tmp_path):
    path = tmp_path / "issues"
    path.mkdir()
    rows = [{"owner": "o", "repo": "r", "pos": "1", "number": 1, "pull_request": {"url": "x"}}, {"owner": "o", "repo": "r", "pos": "2", "number": 2}]
    (path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    assert [r.number for r in landed.scan_issues(spark, str(path), limit=1).collect()] == [2]
    with pytest.raises(ValueError):
        landed.scan_issues(spark, str(path), state="merged")


def test_feed_xml_scan(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>A</title><link>http://a</link><description>d</description><category>x</category></item>"
        "<item><title>B</title><guid>g</guid></item></channel></rss>"
    )
    rows = {r.title: r for r in landed.scan_feed_xml(spark, str(tmp_path / "feed.xml"), "f").collect()}
    assert rows["A"].id == "http://a" and rows["A"].tags == ["x"] and rows["B"].id == "g"


def test_feed_xml_keeps_document_order_of_many_feeds(spark, tmp_path):
    for f, n in (("a", 70), ("b", 1), ("c", 0)):
        items = "".join(f"<item><title>{f}{i}</title><description>{'long ' * 200}</description></item>" for i in range(n))
        (tmp_path / f"{f}.xml").write_text(f"<rss><channel><link>http://{f}</link>{items}</channel></rss>")
    (tmp_path / "d.xml").write_text("no feed at all")
    (tmp_path / "e.xml").write_text("")
    rows = landed.scan_feed_xml(spark, str(tmp_path), F.regexp_extract("path", r"(\w+)\.xml$", 1)).collect()
    assert sorted((r.feed_url, r.pos, r.title) for r in rows) == sorted([("a", i, f"a{i}") for i in range(50)] + [("b", 0, "b0")])
    links = {r.feed_url for r in landed.scan_feed_xml(spark, str(tmp_path), F.col("channel_link"), limit=1).collect()}
    assert links == {"http://a", "http://b"}


def test_feed_xml_of_many_feeds_in_few_files(spark, tmp_path):
    feeds = [(f"{f}.xml", f"<rss><channel><link>http://{f}</link>{'<item><title>t</title></item>' * (f % 60)}</channel></rss>") for f in range(300)]
    spark.createDataFrame([*feeds, ("none.xml", None), ("bad.xml", "no feed at all")], "path STRING, value STRING").coalesce(2).write.parquet(str(tmp_path / "feeds"))
    entries = landed.feed_xml_entries(spark.read.parquet(str(tmp_path / "feeds")), F.col("channel_link"))
    assert entries.rdd.getNumPartitions() <= 2
    rows = entries.collect()
    assert sorted((r.feed_url, r.pos) for r in rows) == sorted((f"http://{f}", i) for f in range(300) for i in range(min(50, f % 60)))


def test_dedupe_rules(spark):
    items = spark.createDataFrame(
        [("u", "k", 1), ("u", "k", 2), ("v", "k", 3), ("u", "", 4), ("u", "", 5), (None, "k", 6), ("u", "old", 7)], "user_id STRING, dedupe_key STRING, pos INT"
    )
    store = spark.createDataFrame([("u", "old"), (None, "k"), ("u", "")], "user_id STRING, source_path STRING")
    assert sorted(r.pos for r in B.new_items(items, store).collect()) == [1, 3, 4, 5]
    assert sorted(r.pos for r in B.new_items(items, store, within_batch=False).collect()) == [1, 2, 3, 4, 5]


def test_stats_count_a_key_once(spark):
    rows = spark.createDataFrame(
        [("u", "e1", "k", 1, None), ("u", "e2", "k", 2, None), ("u", "e2", "", 3, None), ("u", "e2", None, 4, "bad")],
        "user_id STRING, event_id STRING, dedupe_key STRING, pos INT, error STRING",
    )
    store = spark.createDataFrame([], "user_id STRING, source_path STRING")
    got = {r.event_id: (r.total_fetched, r.new_documents, r.duplicates, r.errors) for r in B.ingest_stats(rows, store).collect()}
    assert got == {"e1": (1, 1, 0, 0), "e2": (3, 1, 1, 1)}


def test_names(spark):
    row = one(spark.createDataFrame([('a<b>:"/\\|?*', ' "\'x \n y\'" ', "n" * 256)], "a STRING, b STRING, c STRING").select(
        sanitize_name(F.col("a")).alias("safe"), clean_name(F.col("b")).alias("clean"), clean_name(F.col("c")).alias("cut"),
        clean_name(F.col("c"), overlong="reject").alias("rejected"), sanitize_name(F.lit("")).alias("empty"), truncate(F.col("c"), 256).alias("same"),
        two_decimals(F.lit(0.125)).alias("even"), two_decimals(F.lit(-0.285)).alias("binary"),
    ))
    assert row.safe == "a_b________" and row.clean == "x y" and row.empty == "unknown" and row.same == "n" * 256
    assert row.cut == "n" * 252 + "..." and row.rejected is None
    assert (row.even, row.binary) == (f"{0.125:.2f}", f"{-0.285:.2f}")


def test_replace_and_upsert(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    fresh = spark.createDataFrame([("b", None), ("c", 3)], "k STRING, v INT")
    assert {(r.k, r.v) for r in tables.upsert(current, fresh, ["k"]).collect()} == {("a", 1), ("b", None), ("c", 3)}
    once = tables.replace_by_key(current, fresh, ["k"], fresh.select("k"))
    twice = tables.replace_by_key(once, fresh, ["k"], fresh.select("k"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
