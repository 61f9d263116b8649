"""The facade end to end, and the small label functions."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import maintenance, palette, telemetry, usage
from skerry.service import NOTES, SearchService
from skerry.session import AnalyzerConfig, Settings
from skerry.sources import notes as files

NOW = datetime(2024, 1, 10)


def notes(spark, *rows):
    return spark.createDataFrame([(i, f"n/{i}.md", title, ["#t"], content, len(content), NOW, {"kind": [kind]}, str(hash(content))) for i, title, content, kind in rows], NOTES)


def test_service(spark, tmp_path):
    s = SearchService(spark, f"file://{tmp_path}/s")
    s.index(notes(spark, ("a", "Machine learning", "machine learning for all of us", "x"), ("b", "Cooking", "learning to cook with a machine", "y"), ("c", "Other", "nothing here", "x")))
    s.record([(1, NOW - timedelta(days=1), "u", "click", "b", None), (2, NOW - timedelta(hours=1), "u", "view", "b", None)])
    s.recompute_graph(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string"), NOW)
    ids = lambda q: [r.id for r in s.search(q, NOW).collect()]
    assert ids("machine learning") == ["a", "b"]
    assert ids("machine learning kind:y") == ["b"]
    assert ids("kind:x") == ["a", "c"]
    assert ids("z") == []
    s.pause()
    s.index(notes(spark, ("d", "Machine learning too", "machine learning", "x")))
    assert len(ids("machine learning")) == 2
    s.resume()
    s.index(notes(spark, ("b", "Cooking", "only cooking now", "y"), ("d", "More", "machine learning", "x")))
    assert set(ids("machine learning")) == {"a", "d"}
    s.remove(spark.createDataFrame([("a",)], "id string"))
    assert ids("machine learning") == ["d"]
    counts = {r.term: r.df for r in s.store.read("term_df").collect()}
    assert counts["machine"] == 1 and counts["cooking"] == 1 and "cook" not in counts
    assert s.stats().first().document_count == 3
    assert not s.update_settings(AnalyzerConfig()) and s.update_settings(AnalyzerConfig(stemming=True))
    assert s.stale(notes(spark, ("d", "More", "changed", "x"), ("e", "New", "new", "x"))).count() == 2
    chunks = spark.createDataFrame([("c", 0, [1.0, 0.0]), ("d", 0, [0.9, 0.1])], "id string, chunk_idx int, embedding array<float>")
    both = s.search_stream("machine learning", NOW, [1.0, 0.0], chunks).collect()
    assert {(r.phase, r.id) for r in both} == {("keyword", "d"), ("complete", "d"), ("complete", "c")}
    s.clear()
    assert s.stats().first().document_count == 0


def test_batches_and_upkeep(spark, tmp_path):
    s, told = SearchService(spark, f"file://{tmp_path}/s"), []
    found = lambda q: sorted(r.id for r in s.search(q, NOW).collect())
    s.index(notes(spark, *((str(i), f"Note {i}", f"machine number{i} learning", "x") for i in range(6))), told.append)
    for i in range(3):
        s.index(notes(spark, (str(i), f"Note {i}", f"kitchen number{i}", "x")), told.append)
    assert told == ["index", "notes"] * 4 and found("machine") == ["3", "4", "5"] and found("kitchen") == ["0", "1", "2"]
    s.rename("3", "moved")
    s.remove(spark.createDataFrame([("0",), ("5",)], "id string"))
    before = found("machine"), found("kitchen"), sorted(map(tuple, s.store.load_index()[1].collect()))
    assert before[:2] == (["4", "moved"], ["1", "2"])
    for i in range(2):  # events are only added
        s.record([(i, NOW - timedelta(days=1), "u", "click", "4", None)])
    assert s.store._versions("events") == [1] and s._events().count() == 2
    s.shutdown()
    assert s.store.read("changed") is None and s.paused
    assert (found("machine"), found("kitchen"), sorted(map(tuple, s.store.load_index()[1].collect()))) == before
    s.resume()
    s.trigger_indexing(notes(spark, ("9", "New", "machine too", "x")))
    assert found("machine") == ["4", "9", "moved"]


def test_search_takes_the_settings(spark, tmp_path):
    s = SearchService(spark, f"file://{tmp_path}/s", Settings(analyzer=AnalyzerConfig(stemming=True, synonyms=("car=auto",))))
    s.index(notes(spark, ("a", "x", "many cars there", "x"), ("b", "y", "one auto", "x"), ("c", "z", "nothing", "x")))
    assert sorted(r.id for r in s.search("cars", NOW).collect()) == ["a", "b"]
    plain = SearchService(spark, f"file://{tmp_path}/p", Settings(analyzer=AnalyzerConfig(fold_accents=False, typo_tolerance=0)))
    plain.index(notes(spark, ("a", "x", "naïve", "x"), ("b", "y", "naive", "x")))
    assert [r.id for r in plain.search("naïve", NOW).collect()] == ["a"]


def test_provider_is_tried_again():
    waits, calls = [], []

    def embed(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError
        return [[1.0]]

    assert files.with_retries(embed, 3, waits.append)(["t"]) == [[1.0]] and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        files.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, waits.append)()
    assert files.model_is_there(lambda: ["a:latest", "b"], "a") and not files.model_is_there(lambda: ["b"], "a") and not files.model_is_there(lambda: 1 / 0, "a")


@pytest.mark.parametrize("per", [None, "user"])
def test_bounces_do_not_depend_on_slots(spark, per):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=7 * i % 1000 * 1.3), f"u{i % 3}", "click" if i % 2 else "view", str(i)) for i in range(600)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user string, kind string, path string")
    got = [sorted(map(tuple, usage.bounces(e, seconds=5, per=per, slot=s).collect())) for s in (6, 60, 100_000)]
    assert got[0] == got[1] == got[2] and got[0]


def test_places(spark):
    rows = spark.range(0, 3000, 3)
    assert [r.place for r in maintenance.placed(rows).orderBy("id").collect()] == list(range(1000))
    assert [r.id for r in maintenance.spread_sample(spark.range(10), 4).orderBy("id").collect()] == [0, 2, 5, 7]
    assert maintenance.spread_sample(spark.range(3), 5).count() == 3


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_labels(spark):
    key = lambda *m: one(spark, T.hotkey_label(F.array(*map(F.lit, m)), F.lit("k")))
    assert key("Mod", "Shift") == "Ctrl + Shift + K" and key("Meta", "Ctrl", "Alt", "Shift") == "Hyper + K"
    assert one(spark, T.middle_cut(F.lit("a/b/c/d/e/" + "x" * 60))) == "a/b/.../e/" + "x" * 60
    assert one(spark, T.file_class(F.lit("a/b.PNG"))) == "IMG" and one(spark, T.file_class(F.lit("x.canvas"))) == "CAN"
    assert not one(spark, T.valid_path(F.lit("a:b"))) and not one(spark, T.valid_path(F.lit("  ")))
    assert one(spark, T.highlight(F.lit("This that"), ["th", "that"], True)) == "<mark>Th</mark>is <mark>that</mark>"
    assert one(spark, T.chunk_prefix(F.lit("n"), F.array(F.lit("#a"), F.lit("#b")))) == "n a b"


def test_selection_counts_one_open(spark):
    row = spark.createDataFrame([(NOW, "u", "q", "p")], "ts timestamp, user string, query string, path string")
    each = row.select(F.inline(usage.selection(*(F.col(c) for c in ("ts", "user", "query", "path"))))).collect()
    assert [r.kind for r in each] == ["search", "open"]


def test_usage_export(spark, tmp_path):
    t = spark.createDataFrame([("1.0", "a", 3, NOW, NOW), ("9.0", "b", 1, NOW, NOW), (None, "c", None, None, NOW)], "version string, path string, opens bigint, first_opened timestamp, last_opened timestamp")
    usage.export_json(t, f"file://{tmp_path}/u")
    got = {r.path: (r.opens, r.first_opened) for r in usage.import_json(spark, f"file://{tmp_path}/u").collect()}
    assert got == {"a": (3, NOW), "c": (0, NOW)}


def test_hidden_toggle(spark):
    h = spark.createDataFrame([("a",)], "id string")
    assert palette.toggle(h, "a").count() == 0 and {r.id for r in palette.toggle(h, "b").collect()} == {"a", "b"}


def test_batch_plan():
    assert telemetry.batch_plan(201) == {"batch": 4, "per_file_ms": 75, "per_batch_ms": 200}
    assert telemetry.batch_plan(200)["batch"] == 2


def test_embedding_cache(spark, tmp_path):
    from skerry.sources.notes import embedded, read_embeddings, write_embeddings

    c = spark.createDataFrame([("a", 0, "x", NOW), ("b", 0, "y", NOW)], "path string, chunk_idx int, text string, last_modified timestamp")
    v = embedded(c, lambda texts: [[float(len(t)), 0.0] for t in texts])
    write_embeddings(v, f"file://{tmp_path}/e", "m", 2)
    files = spark.createDataFrame([("a", NOW), ("b", NOW + timedelta(days=1))], "path string, last_modified timestamp")
    assert [r.path for r in read_embeddings(spark, f"file://{tmp_path}/e", files, 2).collect()] == ["a"]
    assert read_embeddings(spark, f"file://{tmp_path}/e", files, 3).count() == 0
