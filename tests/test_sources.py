"""Sources, merges, streams and text functions on small inputs."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from palimpsest.functions import textfns
from palimpsest.functions.timefns import strict_instant, validity_reason
from palimpsest.operators import merge, ops, search
from palimpsest.sources import chunking, history, records
from palimpsest.streaming import state


def test_history_json(spark, tmp_path):
    said = [{"message_id": "m1", "role": "user", "content": "a", "timestamp": "2026-01-01T00:00:00Z"}, {"message_id": "m2", "role": "assistant", "content": "b", "timestamp": "2026-01-01T00:00:01Z"}]
    (tmp_path / "h.json").write_text(json.dumps({"schema": "x", "schema_version": "1", "conversations": [{"conversation_id": "c", "title": "t", "messages": said}]}, indent=1))
    rows = history.history_json(spark, str(tmp_path)).collect()
    assert [(r.conversation_id, r.sequence, r.message_id, r.content) for r in rows] == [("c", 0, "m1", "a"), ("c", 1, "m2", "b")]


def test_history_jsonl(spark):
    lines = [{"type": "header"}, {"type": "message", "conversation_id": "c", "message_id": "early", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "conversation", "conversation_id": "c", "title": "t"}, {"type": "message", "conversation_id": "c", "message_id": "ok", "timestamp": "2026-01-01T00:00:02Z"}, {"type": "message", "conversation_id": "c", "message_id": "back", "timestamp": "2026-01-01T00:00:01Z"}]
    df = spark.createDataFrame([("f", k, json.dumps(x)) for k, x in enumerate(lines)], "file string, line_no long, value string")
    assert {r.message_id: r.valid for r in history.history_jsonl(df).collect()} == {"early": False, "ok": True, "back": False}


def test_history_markdown(spark):
    text = "---\nconversation_id: c9\ntitle: A talk\n---\n## user | 2026-01-01T00:00:00Z | m1\nhello\n\nthere\n## assistant | 2026-01-01T00:00:01Z | m2\nyes\n"
    rows = history.history_markdown(spark.createDataFrame([("p", text)], "path string, value string")).collect()
    assert [(r.conversation_id, r.title, r.role, r.message_id, r.content) for r in rows] == [("c9", "A talk", "user", "m1", "hello\n\nthere"), ("c9", "A talk", "assistant", "m2", "yes")]


def test_chat_export_marks_branches_and_survives_cycles(spark):
    node = lambda parent, text, t: {"parent": parent, "message": {"id": text, "author": {"role": "user"}, "content": {"parts": [text, " "]}, "create_time": t}}
    tree = {"id": "x", "title": "t", "current_node": "c", "mapping": {"a": node(None, "A", 1.0), "b": node("a", "B", 2.0), "c": node("a", "C", 3.0)}}
    loop = {"id": "y", "title": "t", "current_node": "a", "mapping": {"a": node("b", "A", 1.0), "b": node("a", "B", 2.0)}}
    df = spark.createDataFrame([(json.dumps(tree),), (json.dumps(loop),)], "v string").select(F.from_json("v", history.EXPORT).alias("r")).select("r.*")
    rows = history.chat_export(df).collect()
    assert [(r.sequence, r.content, r.on_path) for r in sorted(rows, key=lambda r: r.sequence) if r.conversation_id == "x"] == [(0, "A", True), (1, "B", False), (2, "C", True)]
    assert all(r.on_path for r in rows if r.conversation_id == "y")


def test_zip_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/conversations.json", '[{"id":"c"}]')
        z.writestr("readme.txt", "no")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    read = records.zip_entries(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.zip"))
    assert [(r.entry, r.value) for r in read.collect()] == [("x/conversations.json", '[{"id":"c"}]')]


def test_rollout_drops_repeats_and_zoneless(spark):
    said = lambda i, text, t: json.dumps({"type": "message", "timestamp": t, "payload": {"id": i, "role": "user", "text": text}})
    lines = [json.dumps({"type": "session", "payload": {"id": "s1"}}), said("1", "a", "2026-01-01T00:00:00Z"), said("1", "b", "2026-01-01T00:00:01Z"), said("2", "a", "2026-01-01T00:00:00Z"), "{broken", said("3", "c", "2026-01-01T00:00:00"), said("4", "d", "2026-01-01T00:00:02+01:00")]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_no long, value string")
    rows = sorted(history.rollout(df).collect(), key=lambda r: r.sequence)
    assert [(r.session_id, r.sequence, r.id) for r in rows] == [("s1", 0, "1"), ("s1", 1, "4")]


def test_notes(spark):
    text = "---\nid: n1\ntitle: 'Quoted'\nstatus: active\n---\n# Head\nshort\nThis line is long enough to be a summary.\n"
    r = history.notes(spark.createDataFrame([("p", text), ("q", "no front matter but a long enough line")], "path string, value string")).orderBy("path").collect()
    assert (r[0].id, r[0].title, r[0].summary, r[1].id) == ("n1", "Quoted", "This line is long enough to be a summary.", None)


def test_page_text(spark):
    html = "<html><head><title> A  b </title><style>x{}</style></head><body><script>1<2</script><p>One&nbsp;two</p><div>Three &amp; <b>four</b></div><a href='u'>l</a></body></html>"
    r = spark.createDataFrame([(html,)], "html string").select(history.page_text(F.col("html")).alias("t"), history.page_title(F.col("html")).alias("n"), history.page_links(F.col("html")).alias("l")).first()
    assert (r.t, r.n, r.l) == ("One two\nThree & four\nl", "A b", ["u"])


def test_readable_titles_and_charsets_of_all_pages(spark, tmp_path):
    """Every page has a row with what it declares, also one in another character set, one without any and a null page."""
    import duckdb

    from palimpsest.plans import measure_queries
    from palimpsest.plans.registry import ORACLES

    pages = [
        (1, '<head><meta charset="utf-8"><title>A &amp; b</title></head>'), (2, "<META name=x CHARSET = 'ISO-8859-1' /><TITLE lang=en> One\n two </TITLE>"), (3, "<meta charset=koi8-r><p>none</p>"),
        (4, '<meta http-equiv="Content-Type" content="text/html; charset=windows-1252"><title></title>'), (5, "<title>charset=x</title>"), (6, ""), (7, None),
    ]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in measure_queries.readable_titles(spark, str(tmp_path)).select("page_id", "title", "charset").collect())
    assert got == [(1, "A & b", "utf-8"), (2, "One two", "iso-8859-1"), (3, "", "koi8-r"), (4, "", "windows-1252"), (5, "charset=x", ""), (6, "", ""), (7, None, None)]
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["readable_titles"]).select("page_id, title, charset").fetchall()) == got


def test_spoken_text(spark):
    html = (
        "<html><head><title>A</title><style>p{}</style></head><body>out<p>one &amp; <b>two</b></p>between<script>p<p>no</p></script><ul><li>three<li>four</ul>five"
        "<svg><text>x</text></svg></li>after<PRE class='x'>a  b\nc</pre><!-- <p>gone</p> --><p>last"
    )
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<p>open"), (4, "no tags"), (5, "<p>a</p>\x01\x02<h1>b</h1>")], "page_id long, html string")
    got = {r.page_id: r.t for r in rows.select("page_id", history.spoken_text(F.col("html")).alias("t")).collect()}
    assert got == {1: "one & two\nthree four five\na b c\nlast", 2: "", 3: "open", 4: "", 5: "a\nb"}


def test_chunks_hold_all_text():
    text = "intro\n\n# A\n\n" + "x" * 3000 + "\n\nend\n## B\n" + "\n\n".join("p" * 500 for _ in range(5))
    got = chunking.chunk(text, 1200, 150)
    assert [c.heading for c in got][:2] == [chunking.NO_HEADING, "A"] and got[-1].heading == "A / B"
    assert max(len(c.text) for c in got) <= 1200 + 152 and sum(c.text.count("x") for c in got) >= 3000
    assert chunking.chunk("") == []


def test_instants_need_a_zone(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00",), ("2026-01-01T00:00:00Z",), ("x",), (None,)], "t string")
    assert [r[0] is None for r in df.select(strict_instant(F.col("t"))).collect()] == [True, False, True, True]
    late = F.to_timestamp(F.lit("2026-03-01T00:00:00Z"))
    rows = spark.createDataFrame([("superseded", "2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z"), ("superseded", "2026-01-01T00:00:00Z", None), ("active", "2026", None), (None, None, None)], "s string, f string, t string")
    of = lambda mode: [r[0] for r in rows.select(validity_reason(F.col("s"), F.col("f"), F.col("t"), mode, late)).collect()]
    assert of("current") == ["status_superseded", "status_superseded", "malformed_valid_from", "missing_status"]
    assert of("as_of") == ["expired", "valid_at_requested_time", "malformed_valid_from", "missing_status"]
    assert of("history") == ["history_requested", "history_requested", "malformed_valid_from", "history_requested"]


def test_privacy_masks_in_order(spark):
    text = "mail a.b@c.org password: hunter22 card 4111 1111 1111 1111 and sk-abcdefghijklmnop1234"
    r = spark.createDataFrame([(text,)], "t string").select(textfns.redact(F.col("t")).alias("r"), textfns.privacy_class(F.col("t")).alias("c")).first()
    assert r.r == "mail [REDACTED:email] [REDACTED:password] card [REDACTED:bank_card]and [REDACTED:api_key]" and r.c == "restricted"


def test_urls(spark):
    urls = ["HTTPS://Ex.org:443/a/?b=2&utm_source=x&a=1#f", "http://ex.org:8080", "ftp://ex.org/", "", "http://ex.org/p/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(textfns.normalise_url(F.col("u"))).collect()]
    assert got == ["https://ex.org/a?a=1&b=2", "http://ex.org:8080/", "", "", "http://ex.org/p"]


def test_overlapping_occurrences(spark):
    assert spark.createDataFrame([("AAAA",)], "t string").select(textfns.occurrences(F.col("t"), "aaa")).first()[0] == 2


def test_short_terms_match_nothing(spark):
    df = spark.createDataFrame([(1, "ab", "", "ab", "")], "chunk_id long, title string, heading string, text string, tags string")
    assert search.lexical(df, ["ab"]).count() == 0 and search.substring(df, ["ab"]).count() == 1


def test_late_events_in_a_batch(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k long, t long, r long, v string")
    assert merge.latest(rows, ["k"], ["t", "r"]).first().v == "b"


def test_late_events_in_a_stream(spark, tmp_path):
    schema = "k long, t long, r long, v string"
    parts = [[(1, 5, 1, "a"), (2, 1, 1, "x")], [(1, 4, 9, "old"), (2, 1, 0, "low"), (2, 1, 3, "y")]]
    seen: dict[int, str] = {}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.latest_state(state.read_new_files(spark, str(tmp_path / "in"), schema), "k", "t", "r", "v")
        state.run_available(stream, lambda df, _: seen.update({r.k: r.v for r in df.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == {1: "a", 2: "y"}


def test_late_events_with_times_and_numbers(spark, tmp_path):
    schema = "k string, t timestamp, r int, v double"
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    seen: dict[str, float] = {}
    for part in ([("a", at(5), 1, 1.5)], [("a", at(4), 9, 2.5), ("b", at(1), 1, 0.5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.latest_state(state.read_new_files(spark, str(tmp_path / "in"), schema), "k", "t", "r", "v")
        state.run_available(stream, lambda df, _: seen.update({r.k: r.v for r in df.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == {"a": 1.5, "b": 0.5}


def test_changes_wait_for_the_first_of_them(spark, tmp_path):
    schema = "k string, t timestamp"
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    seen: list[tuple] = []
    for part in ([("a", at(0)), ("a", at(2)), ("a", at(4)), ("a", at(11))], [("b", at(30))], [("b", at(31))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.debounced(state.read_new_files(spark, str(tmp_path / "in"), schema), "k", "t", 5000)
        state.run_available(stream, lambda df, _: seen.extend((r.k, r.first_ms % 60_000, r.n) for r in df.collect()), str(tmp_path / "cp"), mode="append").awaitTermination(120)
    assert sorted(seen) == [("a", 0, 3), ("a", 11_000, 1)]


def test_duplicates_within_a_window(spark, tmp_path):
    schema = "k string, t timestamp"
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    seen: list[tuple] = []
    for part in ([("a", at(0)), ("a", at(3)), ("b", at(4))], [("c", at(40))], [("a", at(41))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.suppress_duplicates(state.read_new_files(spark, str(tmp_path / "in"), schema), ["k"], "t", "10 seconds")
        state.run_available(stream, lambda df, _: seen.extend((r.k, r.t.second) for r in df.collect()), str(tmp_path / "cp"), mode="append").awaitTermination(120)
    assert sorted(k for k, _ in seen) == ["a", "a", "b", "c"]


def test_coverage_of_nothing_is_whole(spark):
    none = spark.createDataFrame([], "k long")
    assert ops.coverage(none, none, "k").first().ratio == 1.0


def test_upsert_and_replace(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, born int"), spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k long, v string, born int")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ("born",)).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 9)]
    assert sorted(map(tuple, merge.replace_rows(old, new, "k").collect())) == [(1, "a", 1), (2, "c", 9), (3, "d", 9)]
    assert merge.record_once(old, new, "k").count() == 1


def test_stateful_streams_go_on_from_their_checkpoint(spark, tmp_path):
    """Two runs of one query: late events change nothing, what is pending waits in the state and is told by a timer later."""
    from palimpsest.streaming import processors

    at = lambda s: f"2026-01-01T00:00:{s:02d}Z"
    make = lambda rows: spark.createDataFrame(rows, "k string, s string, r int, v string").withColumn("t", F.to_timestamp("s")).drop("s")
    latest, groups = {}, []
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, processors._PROVIDER)
    try:
        for run in ([("a", at(5), 1, "x"), ("a", at(6), 1, "y"), ("b", at(1), 1, "z")], [("a", at(5), 9, "late"), ("a", at(6), 2, "w"), ("a", at(6), 1, "no"), ("a", at(40), 1, "end")]):
            make(run).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema("k string, r int, v string, t timestamp").parquet(str(tmp_path / "in"))
            for stream, mode, write in (
                (processors.latest_by_rule(source, "k", "t", "r", "v"), "update", lambda df, _: latest.update({r.k: r.v for r in df.collect()})),
                (processors.grouped_changes(source, "k", "t", 3000, "10 seconds"), "append", lambda df, _: groups.extend((r.k, r.first_ms // 1000 % 60, r.n) for r in df.collect())),
            ):
                stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{mode}")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    assert latest == {"a": "end", "b": "z"} and sorted(groups) == [("a", 5, 5), ("b", 1, 1)]


def test_archive_lines(spark, tmp_path):
    """Ranges of any size give each line once; a stream gives what was appended, whole lines only."""
    from palimpsest.sources import lines

    lines.register(spark)
    box = tmp_path / "box" / "in"
    box.mkdir(parents=True)
    text = "".join(f"line {k} é\n" for k in range(40)) + "\n\r\nlast without a break"
    (box / "a.jsonl").write_text(text, newline="")
    (box / "b.jsonl").write_text("")
    (box / "c.txt").write_text("no\n")
    want = [x.rstrip("\r") for x in text.split("\n")]
    for size in (1, 7, 64, 1 << 20):
        rows = spark.read.format(lines.FORMAT).option("rangeBytes", size).load(str(tmp_path / "box")).orderBy("position").collect()
        assert [r.line for r in rows] == want and {r.file for r in rows} == {"in/a.jsonl"}

    seen = []

    def run():
        stream = spark.readStream.format(lines.FORMAT).load(f"file://{tmp_path}/box")
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(sorted((r.file, r.line) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        out = list(seen)
        seen.clear()
        return out

    assert len(run()) == 42
    with (box / "a.jsonl").open("a") as f:
        f.write(" now\nnext\nhal")
    (box / "d.jsonl").write_text("one\n")
    assert run() == [("in/a.jsonl", "last without a break now"), ("in/a.jsonl", "next"), ("in/d.jsonl", "one")]
    assert run() == []
