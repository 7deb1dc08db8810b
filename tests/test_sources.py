"""Readers, sinks and the streaming extension on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.sources import readers as R
from quillstream.sources import sinks
from quillstream.streaming import events as E


def test_json_lines_route_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": 1, "b": "x"}\n\n[1]\n{"a": 2, "c": 3}\nnot json\n', encoding="utf-8")
    rows, rejects = R.json_lines(spark, str(tmp_path), "a int, b string")
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "x"), (2, None)]
    assert sorted(r["raw"] for r in rejects.collect()) == ["[1]", "not json"]
    df = spark.createDataFrame([('{"a":1,"c":2}',)], "raw string")
    assert df.select(R.extra_keys(F.col("raw"), ["a"])).first()[0] == ["c"]


def test_strict_json(tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"a": 1}')
    assert R.strict_json(str(p)) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        p.write_text(bad)
        with pytest.raises(ValueError):
            R.strict_json(str(p))


def entry(video, channel="UC1", title="t", published="2024-01-01T00:00:00+00:00", description="d"):
    return f"<entry><yt:videoId>{video}</yt:videoId><yt:channelId>{channel}</yt:channelId><title>{title}</title><published>{published}</published><updated>{published}</updated><media:group><media:description>{description}</media:description><media:community><media:statistics views=\"7\"/></media:community></media:group></entry>"


def test_atom_reasons(spark):
    vids = ["A" * 11, "short", "B" * 11, "A" * 11, "C" * 11, "D" * 11, "E" * 11, "F" * 11]
    body = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="y" xmlns:media="m"><title>label</title>' + "".join([
        entry(vids[0]), entry(vids[1]), entry(vids[2], channel="UC2"), entry(vids[3]), entry(vids[4], published="2025-01-01T00:00:00Z"), entry(vids[5], published="bad"), entry(vids[6], title="", description=""), entry(vids[7])]) + "</feed>"
    df = spark.createDataFrame([("UC1", "2024-06-01T00:00:00Z", body), ("UC9", "2024-06-01T00:00:00Z", "<!DOCTYPE x>" + body)], "channel_id string, received_at string, body string")
    got = {r["entry_index"]: r for r in R.atom(df, max_entries=5).collect()}
    assert [got[i]["reason"] for i in range(8)] == [None, "invalid_video_id", "entry_channel_mismatch", "duplicate_video_id", "future_dated", "missing_or_invalid_timestamp", "empty_text", None]
    assert got[0]["view_count"] == 7 and got[0]["text"] == "t\nd" and got[0]["label"] == "label"
    assert {r["entry_index"]: r["reason"] for r in R.atom(df, max_entries=1).collect()}[7] == "configured_entry_limit"


def test_rss_reasons(spark):
    item = lambda t, d, n="": f"<item><title>{t}</title><link>l</link><pubDate>{d}</pubDate><ht:approx_traffic>1K+</ht:approx_traffic>{n}</item>"
    ok = "Mon, 01 Jan 2024 09:00:00 +0900"
    body = '<rss xmlns:ht="h"><channel><title>c</title>' + item("a", ok, "<ht:news_item><ht:news_item_title>n</ht:news_item_title></ht:news_item>") + item("", ok) + item("b", "Mon, 01 Jan 2024 09:00:00") + item("c", "Wed, 01 Jan 2025 00:00:00 +0000") + item("a", ok) + item("z", ok) + "</channel></rss>"
    df = spark.createDataFrame([("2024-06-01T00:00:00Z", body)], "received_at string, body string")
    got = R.rss(df, max_entries=1).orderBy("feed_position").collect()
    assert [r["reason"] for r in got] == [None, "empty_topic", "missing_or_invalid_timezone_pubDate", "future_pubDate", "duplicate_feed_item", "configured_entry_limit"]
    assert got[0]["approx_traffic_raw"] == "1K+" and got[0]["approx_traffic_numeric"] is None and got[0]["news"] == 1


def test_search_cards_skip_ads_and_repeats(spark):
    card = lambda v, t: {"videoRenderer": {"videoId": v, "title": {"runs": [{"text": t}]}, "ownerText": {"runs": [{"navigationEndpoint": {"browseEndpoint": {"browseId": "UC" + "x" * 22}}}]}, "publishedTimeText": {"simpleText": "1 day ago"}}}
    data = {"contents": {"twoColumnSearchResultsRenderer": {"primaryContents": [card("A" * 11, "one {"), {"adSlotRenderer": card("Z" * 11, "ad")}, card("A" * 11, "again"), card("bad", "x"), card("B" * 11, "two")]}}}
    html = f"<script>var ytInitialData = {json.dumps(data)};</script>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<html>")], "page_id long, html string")
    got = R.search_cards(df).orderBy("search_rank").collect()
    assert [(r["video_id"], r["reason"]) for r in got] == [("A" * 11, None), ("A" * 11, "duplicate_video_card"), (None, "malformed_renderer"), ("B" * 11, None)]
    assert got[0]["title"] == "one {" and got[0]["channel_id"].startswith("UC") and got[0]["publication_label"] == "1 day ago"


def test_watch_metadata_precedence_and_identity(spark):
    v = "A" * 11
    player = lambda i: f'<script>var ytInitialPlayerResponse = {json.dumps({"videoDetails": {"videoId": i, "title": "t"}, "microformat": {"playerMicroformatRenderer": {"publishDate": "2024-01-01"}}})};</script>'
    linked = f'<script type="application/ld+json">{json.dumps({"@type": "VideoObject", "url": f"https://x/watch?v={v}", "name": "n", "description": "d"})}</script>'
    rows = [(v, player(v) + linked), (v, player("B" * 11)), (v, linked), (v, "<html>"), (v, "<title>Before you continue to x")]
    got = R.watch_metadata(spark.createDataFrame(rows, "video_id string, html string")).collect()
    assert [(r["title"], r["description"], r["reason"]) for r in got] == [("t", "d", None), (None, None, "video_identity_mismatch"), ("n", "d", None), (None, None, "metadata_unavailable"), (None, None, "consent_required")]


def test_paragraphs(spark):
    df = spark.createDataFrame([("<p class=x>a <b>b</b><sup>[1]</sup> &amp; c</p><p> </p><P>d\n e</P>",)], "h string")
    assert df.select(R.paragraphs(F.col("h"))).first()[0] == ["a b & c", "d e"]


def test_files_archive_and_sinks(spark, tmp_path):
    for name, body in (("a.txt", b"x"), ("b.TXT", b"x"), ("c.bin", b"y")):
        (tmp_path / name).write_bytes(body)
    found = R.files(spark, str(tmp_path)).cache()
    assert found.count() == 3
    assert {(r["paths"], r["name"][64:]) for r in sinks.content_addressed(found).collect()} == {(2, ".txt"), (1, ".bin")}
    rows = found.orderBy("path").collect()
    receipts = spark.createDataFrame([(rows[0]["path"], rows[0]["sha256"]), (rows[1]["path"], "0"), ("gone", "1")], "path string, sha256 string")
    assert {r["state"] for r in R.verified_archive(found, receipts).collect()} == {"verified", "hash_mismatch", "missing_file", "no_receipt"}
    out = str(tmp_path / "out")
    sinks.write_several({"one": receipts}, out)
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(receipts, out + "/one")
    back = spark.read.json(out + "/one")
    assert sum(r["rows"] for r in sinks.manifest(back).collect()) == 3
    links = spark.createDataFrame([("https://youtu.be/x",), ("http://youtu.be/x",), ("https://evil.example/x",), (None,)], "u string").select(sinks.report_link(F.col("u"))).collect()
    assert [r[0] for r in links] == ["https://youtu.be/x", None, None, None]


def test_stream_continues_where_it_ended(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [(1, "a", 0), (2, "a", 3600), (3, "b", 90000), (1, "a", 0)]
    make = lambda rs: spark.createDataFrame([(i, t, float(s)) for i, t, s in rs], "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("value") + 1.7e9)).select("event_id", "ts", "event_type", "value")
    make(rows).write.parquet(src)
    E.run_once(E.first_seen(E.stream(spark, src, schema), ["event_id"]), out, mark)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    make([(4, "b", 90001), (3, "b", 90000)]).write.mode("append").parquet(src)
    E.run_once(E.first_seen(E.stream(spark, src, schema), ["event_id"]), out, mark)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    counts, cmark = str(tmp_path / "counts"), str(tmp_path / "cmark")
    E.run_once(E.windowed_counts(E.stream(spark, src, schema)), counts, cmark)
    assert {(r["event_type"], r["n"]) for r in spark.read.parquet(counts).collect()} >= {("a", 3)}
