import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding as U
from quillspark.operators import sinks, state
from quillspark.sources import rss, tables
from quillspark.streaming import logs

FEED = """<?xml version="1.0"?><rss xmlns:itunes="i" xmlns:content="c" xmlns:dc="d" xmlns:psc="p"><channel><title> Show &amp; tell </title><description>About</description><language>en-us</language>
<itunes:author>Ann</itunes:author><itunes:image href="http://x/i.png"/><link>http://x</link>
<item><title>One</title><guid isPermaLink="false">guid-episode-1</guid><description>Rock & roll</description><content:encoded><![CDATA[<p>Hi</p>]]></content:encoded><pubDate>Sat, 13 Aug 2022 09:00:56 +0000</pubDate>
<itunes:duration>1:00</itunes:duration><dc:creator>Bo</dc:creator><enclosure url="http://x/a.mp3" type="audio/mpeg" length="123"/><psc:chapters><psc:chapter start="00:00" title=" In "/><psc:chapter start="" title="x"/></psc:chapters></item>
<item><title>Two</title><enclosure url="u" length="12x"/></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "show-1.xml").write_text(FEED)
    (tmp_path / "show-2.xml").write_text("not a feed")
    feeds = rss.read_feeds(spark, str(tmp_path))
    show = rss.shows_of(feeds).collect()
    assert [(s.show_id, s.title, s.author, s.image_url) for s in show] == [("show-1", "Show & tell", "Ann", "http://x/i.png")]
    one, two = rss.episodes_of(feeds).orderBy("title").collect()
    assert (one.guid, one.description, one.content_encoded, one.duration, one.audio_length, one.creator) == ("guid-episode-1", "Rock & roll", "<p>Hi</p>", "1:00", 123, "Bo")
    assert [tuple(c) for c in one.chapters] == [("00:00", "In")] and one.episode_id.endswith("fff2a0ca")
    assert (two.guid, two.audio_length, two.chapters) == ("", None, None) and two.episode_id.endswith("d41d8cd9")


def test_json_sources(spark, tmp_path):
    d = tmp_path / "shows"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"show_id": "a", "updated_at": "2024"}))
    (d / "b.json").write_text("{broken")
    assert [(r.show_id, r.provider, r.language_uncertain) for r in tables.read_json_dir(spark, str(d)).collect()] == [("a", "apple_podcasts", 0)]
    log = tmp_path / "q.jsonl"
    log.write_text('{"request_id": "r", "query": "x"}\n\nnonsense\n')
    assert [r.request_id for r in tables.read_jsonl(spark, str(log), "query_log").collect()] == ["r"]
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "click_log").count() == 0
    (tmp_path / "j.json").write_text(json.dumps({"judgments": {"q": {"e": {"score": 0.5, "relevance": 2}}}}))
    assert [tuple(r) for r in tables.read_judgments(spark, str(tmp_path / "j.json")).collect()] == [("q", "e", 0.5, 2)]
    (tmp_path / "q.txt").write_text(" a b \n\n c\n")
    assert [r.query for r in tables.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["a b", "c"]


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE shows (show_id TEXT, n INTEGER, x REAL)")
    con.executemany("INSERT INTO shows VALUES (?, ?, ?)", [(f"s{i}", i, i / 2) for i in range(10)])
    con.commit()
    con.close()
    got = tables.read_sqlite(spark, p, "shows", 3)
    assert got.count() == 10 and got.agg(F.sum("n")).first()[0] == 45


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "late"), ("c", 1, "n")], "k string, v int, t string")
    once = state.upsert_latest(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "z"), ("b", 5, "y"), ("c", 1, "n")]
    assert sorted(map(tuple, state.upsert_latest(once, new, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_partial_update_keeps_vectors(spark):
    old = spark.createDataFrame([("a", "t", [1.0], "2024")], "id string, title string, embedding array<double>, created_at string")
    new = spark.createDataFrame([("a", "T", "2025"), ("b", "U", "2025")], "id string, title string, created_at string")
    got = {r.id: (r.title, r.embedding, r.created_at) for r in state.partial_update(old, new, "id").collect()}
    assert got == {"a": ("T", [1.0], "2024"), "b": ("U", None, "2025")}


def test_backfill_and_reverse(spark, tmp_path):
    cols = "episode_id string, show_id string, embedding_status string, embedding_model string, embedding_version string, last_embedded_at string"
    rows = [
        ("ok", "s", "pending", "m", "m/text-v1", "t"), ("blank", "s", "done", None, "", None), ("part", "s", "done", "m", None, None), ("lost", "t", "done", "m", "text-v1", "t"),
        ("unread", "u", "done", "m", "text-v1", "t"), ("dims", "v", "done", "m", "text-v1", "t"), ("gone", "s", "done", "m", "text-v1", "t"),
    ]
    status = spark.createDataFrame(rows, cols)
    cache = spark.createDataFrame([("s", "ok", "m", "text-v1", 2, [1.0, 0.0], True), ("u", "unread", "m", "text-v1", 2, [1.0, 0.0], False), ("v", "dims", "m", "text-v1", 3, [1.0], True)], "show_id string, episode_id string, model_name string, embedding_version string, embedding_dimensions int, embedding array<double>, readable boolean")
    c = state.backfill_categories(status, cache, 2)
    assert {r.episode_id: r.category for r in c.collect()} == {
        "ok": "pass", "blank": "neutral_metadata_absent", "part": "anomaly_partial_metadata", "lost": "anomaly_cache_missing", "unread": "fail_payload_unreadable", "dims": "fail_payload_identity_mismatch", "gone": "fail_episode_entry_missing",
    }
    assert state.backfill_decision(c, override=True).first().decision == "blocked_hard"
    store = sinks.Store(spark, str(tmp_path / "store"))
    snap = store.snapshot(status, "status", ["episode_id"])
    applied = state.apply_backfill(status, c)
    assert {r.episode_id: r.embedding_status for r in applied.collect()}["ok"] == "done"
    assert store.restore(snap["version"], status)[0] == "noop"
    what, back = store.restore(snap["version"], applied)
    assert what == "restored" and sorted(map(str, back.collect())) == sorted(map(str, status.collect()))
    assert store.restore(snap["version"], applied.where("episode_id <> 'ok'"))[0] == "drifted"
    assert store.restore(snap["version"], applied.where("episode_id <> 'ok'"), force=True, reason="test")[0] == "restored"


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    a, b = spark.range(3), spark.range(2)
    assert store.commit(a, "episodes-en") and store.read("episodes-en").count() == 3
    assert not store.commit(b, "episodes-en", errors=1) and store.read("episodes-en").count() == 3
    assert not store.migrate(b, "episodes-en")["passed"] and store.aliases() == {"episodes-en": "episodes-en-v1"}
    assert store.migrate(spark.range(4), "episodes-en")["passed"] and store.read("episodes-en").count() == 4
    with pytest.raises(ValueError):
        store.drop_version(store.aliases()["episodes-en"])
    with pytest.raises(ValueError):
        store.write_version(a, "strict", schema="other bigint")
    assert store.since(["x"]) == "" and not store.advance("x", "2024", dry_run=True) and store.advance("x", "2024") and store.since(["x"]) == "2024" and store.since(["x", "y"]) == ""


def test_logs_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("r", "2024-01-01T00:00:00Z")], "request_id string, timestamp string")
    assert sinks.append_log(rows, str(tmp_path / "log")) and sinks.append_log(rows, str(tmp_path / "log"))
    assert tables.read_jsonl(spark, str(tmp_path / "log"), "query_log").count() == 2
    (tmp_path / "f").write_text("")
    assert not sinks.append_log(rows, str(tmp_path / "f" / "x"))
    assert "| r | 2024" in sinks.report_markdown("t", rows)
    with pytest.raises(ValueError):
        sinks.report_markdown("t", spark.range(20), most=10)


def test_embedding(spark):
    inputs = spark.createDataFrame([("a", "s", "hello world"), ("b", "s", "other"), ("c", "t", " ")], "episode_id string, show_id string, text string")
    cache = spark.createDataFrame([("a", "m", "m/text-v1", [1.0] * 4, "2024-01-01 00:00:00", 1)], "episode_id string, model_name string, embedding_version string, embedding array<float>, embedded_at string, vec_id bigint")
    ident = {"model": "m", "version": "text-v1", "dims": 4}
    got = {r.episode_id: r.source for r in U.embed_missing(inputs, cache, lambda: U.hash_backend(4), ident).collect()}
    assert got == {"a": "cache", "b": "backend"}
    with pytest.raises(Exception, match="no vector for b"):
        U.embed_missing(inputs, cache, lambda: U.hash_backend(4), ident, strict=True).collect()
    with pytest.raises(Exception, match="4 expected"):
        inputs.select(U.embed(F.col("text"), lambda: U.hash_backend(5), 4)).collect()
    _, shows = U.rebuild_shows(inputs, lambda: U.hash_backend(4), ident)
    assert {r.show_id: r.status for r in shows.collect()} == {"s": "ok", "t": "zero_episodes"}


def test_cache_migration(spark):
    kind = "show_id string, model_name string, embedding_version string, embeddings map<string,array<float>>"
    e = {"x": [1.0]}
    flat = spark.createDataFrame([("a", "m", "m/text-v1", e), ("b", None, "v", e), ("c", "zz", "v", e), ("d", "m", "text-v1", e), ("f", "m", "text-v1", e)], kind)
    old = spark.createDataFrame([("d", "m", "text-v1", e), ("f", "m", "text-v1", {"x": [2.0]})], kind)
    got = {r.show_id: r.outcome for r in sinks.migrate_cache(flat, old, {"m": 1}).collect()}
    assert got == {"a": "migrated_ok", "b": "unmigrated_missing_metadata", "c": "unmigrated_infer_failed", "d": "conflict_existing_same", "f": "conflict_existing_different"}


def test_streams(spark, tmp_path):
    q, c = tmp_path / "q", tmp_path / "c"
    q.mkdir(), c.mkdir()
    (q / "1.json").write_text("\n".join(json.dumps({"request_id": f"r{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "mode": "bm25", "selected_lang": "en", "result_count": i % 2}) for i in (0, 1, 2, 2, 59)) + "\nbroken")
    (c / "1.json").write_text("\n".join(json.dumps({"request_id": r, "timestamp": t, "clicked_rank": 1}) for r, t in (("r0", "2024-01-01T00:00:10Z"), ("r1", "2024-01-01T00:02:00Z"))))
    qs, cs = logs.log_stream(spark, str(q), "query_log"), logs.log_stream(spark, str(c), "click_log")
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(logs.successful_queries(qs, cs), "hits", "append")
    assert [r.q_id for r in spark.table("hits").collect()] == ["r0"]
    run(logs.traffic(qs), "traffic", "complete")
    assert [(r.queries, r.empty) for r in spark.table("traffic").collect()] == [(4, 2)]
    run(logs.sessions(qs), "sess", "complete")
    assert sorted(r.queries for r in spark.table("sess").collect()) == [1, 4]
    store = sinks.Store(spark, str(tmp_path / "st"))
    logs.upsert_stream(qs, store, "log", ["request_id"], ["timestamp"], str(tmp_path / "ck")).start().awaitTermination()
    assert store.read("log").count() == 4


def test_document_rejections(spark):
    inputs = spark.createDataFrame([("e1", "s"), ("e2", "s"), ("e3", "t")], "episode_id string, show_id string")
    from quillspark import schema

    c = {"normalized": {"title": "T", "description": "D"}, "paragraphs": [], "stats": None}
    m = {"guid": None, "pub_date": None, "duration": "1:00", "audio_url": "u", "language": "en-US", "chapters": None}
    cleaned = spark.createDataFrame([("e1", "s", "", c, m, None), ("e3", "t", "other", c, m, None)], schema.CLEANED_EPISODE)
    shows = spark.createDataFrame([("s", "S", "A", "podcast-episodes-en"), ("t", "T", "A", None)], "show_id string, title string, author string, target_index string")
    got = {r.episode_id: (r.alias, r.reject_reason, r.duration_sec) for r in state.episode_documents(inputs, cleaned, shows).collect()}
    assert got == {"e1": ("episodes-en", None, 60), "e2": ("episodes-en", "no_cleaned_episode", None), "e3": (None, "unknown_target", 60)}


def test_nested_documents(spark):
    eps = spark.createDataFrame([("e1", "s", "own words are here\n\nUse code SAVE20 for 20% off"), ("e2", "s", None)], "episode_id string, show_id string, description string")
    from quillspark.operators import cleaning

    judged = cleaning.judged_paragraphs(cleaning.paragraph_table(eps, F.col("description")))
    docs = {r.episode_id: r.cleaned for r in cleaning.cleaned_documents(judged, eps.withColumn("title", F.lit("Ｔ"))).collect()}
    one = docs["e1"]
    assert one.normalized.title == "T" and one.normalized.description == "own words are here"
    assert [(p["index"], p.kept, p.flags) for p in one.paragraphs] == [(0, True, ["content"]), (1, False, ["sponsor"])]
    assert (one.stats.total_paragraphs, one.stats.removed_paragraphs, one.stats.removal_breakdown) == (2, 1, {"sponsor": 1})
    assert docs["e2"].paragraphs == [] and docs["e2"].stats.total_paragraphs == 0


def test_small_helpers(spark, tmp_path):
    from quillspark.operators import evaluation

    for day in ("2024-01-01", "2024-02-01", "other"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "r.json").write_text(json.dumps({"day": day}))
    assert tables.latest_report(spark, str(tmp_path), "r.json").first().day == "2024-02-01"
    assert tables.latest_report(spark, str(tmp_path), "none.json") is None
    rows = spark.createDataFrame([("a", f"e{i}") for i in range(20)] + [("b", "x")], "category string, episode_id string")
    assert {r.category: len(r.ids) for r in state.sample_ids(rows).collect()} == {"a": 10, "b": 1}
    assert len(evaluation.measure_latency(lambda *_: None, [("q", "en", "bm25")], 3)) == 3
    assert [s for _, _, s in evaluation.online_report(0.6, 0.7, None, 0.2)] == ["PASS", "FAIL", "N/A", "PASS"]
    c = U.chunks(spark.createDataFrame([("a", "x"), (None, "y"), ("b", " ")], "episode_id string, text string"))
    assert [tuple(r) for r in c.collect()] == [("a", 0, "x")]


def test_http_backend():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    fails = [1]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            if fails and fails.pop():
                self.send_error(503)
                return
            body = json.dumps({"data": [{"index": i, "embedding": [len(t), 1.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    backend = U.http_backend(f"http://127.0.0.1:{server.server_port}/", pause=0.01)
    assert backend(["abc"]).tolist() == [[3.0, 1.0]] and backend(["a", "bb"]).tolist() == [[1.0, 1.0], [2.0, 1.0]]
    server.shutdown()


def test_buckets_are_rewritten_only_where_touched(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(i, 1, "old") for i in range(100)], "id int, at int, v string")
    assert len(store.merge_buckets(rows, "t", ["id"], ["at"], 8)) == 8
    before = store._buckets("t")
    touched = store.merge_buckets(spark.createDataFrame([(5, 2, "new"), (6, 0, "late"), (500, 1, "more")], rows.schema), "t", ["id"], ["at"], 99)
    after = store._buckets("t")
    assert {i for i in after if after[i] != before[i]} == set(touched) and len(touched) <= 3 and set(after) == set(range(8))
    got = {r.id: r.v for r in store.read("t").collect()}
    assert len(got) == 101 and (got[5], got[6], got[500], got[7]) == ("new", "old", "more", "old")
    assert store.merge_buckets(rows.limit(0), "t", ["id"], ["at"]) == []


def test_versions_are_claimed_and_the_manifest_is_never_gone(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "c"))
    df = spark.range(3)
    store._claim("_claims/d-v1")
    assert store.write_version(df, "d") == "d-v2"
    store.publish("a", "d-v2")
    seen = []
    write = sinks.os.replace

    def watched(src, dst):
        seen.append(store.aliases())
        write(src, dst)
        seen.append(store.aliases())

    sinks.os.replace = watched
    try:
        store.publish("b", "d-v2")
    finally:
        sinks.os.replace = write
    assert seen == [{"a": "d-v2"}, {"a": "d-v2", "b": "d-v2"}]


def test_cuts_are_released(spark):
    from pathlib import Path

    from quillspark import session

    df = session.cut_lineage(spark.range(5))
    path = Path(session.shared_folder(spark).removeprefix("file:"))
    assert df.count() == 5 and list(path.glob("cut-*"))
    assert session.release_cuts(spark) >= 1 and not list(path.glob("cut-*"))


def test_migration_of_sync_rows(spark):
    old = spark.createDataFrame([("episode", "e1", "a", "synced", "2024-01-01"), ("episode", "e1", "b", None, "2024-02-01"), ("show", "s1", None, None, None)], "entity_type string, entity_id string, index_alias string, sync_status string, last_synced_at string")
    new = state.migrate_sync_state(old)
    assert {(r.entity_id, r.environment, r.index_alias, r.sync_status) for r in new.collect()} == {("e1", "default", "b", "pending"), ("s1", "default", None, "pending")}
    assert sorted(map(tuple, state.migrate_sync_state(new).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_shows_and_feed_files(spark):
    shows = spark.createDataFrame([("show:apple:1",), ("show:apple:2",), (None,)], "show_id string")
    files = spark.createDataFrame([("/x/show_apple_1.xml",), ("/a/show_apple_1.xml",), ("/x/show_apple_9.rss",), (None,)], "path string")
    got = {tuple(r) for r in state.shows_with_feeds(shows, files).collect()}
    assert got == {("show:apple:1", "/a/show_apple_1.xml", "matched"), ("show:apple:2", None, "no_feed"), (None, "/x/show_apple_9.rss", "no_show")}
