"""Flows, stored postings, percentiles by parts, scans that survive unreadable files."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import uris
from kgspark.operators import graph, index, links, retrieval
from kgspark.operators.postings import bare, phrases_of, search_blocks, search_postings, tokens, write_postings
from kgspark.sources.adjacency import edges_from_json, select_provider
from kgspark.sources.markdown import list_bases, scan_markdown, scan_report


def test_percentiles_by_parts(spark):
    """Exact interpolated percentiles: ties, one value, few values, many orders of size."""
    rng = random.Random(1)
    groups = {"tied": [0.25] * 400 + [1.0], "one": [3.0], "two": [1.0, 2.0], "wide": [10 ** rng.uniform(-12, 3) for _ in range(3001)], "near": [1 + rng.random() * 1e-6 for _ in range(500)]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "vault string, rank double").repartition(4)
    at = (0.0, 0.5, 0.8, 0.95, 0.99, 1.0)
    got = {r["vault"]: r for r in graph.cuts(rows, at).collect()}
    for k, vs in groups.items():
        assert got[k]["p"] == pytest.approx(list(np.quantile(vs, at)), rel=1e-12) and got[k]["n"] == len(vs) and got[k]["top"] == max(vs)


def test_pagerank_stops_early(spark):
    """The default tolerance ends the rounds; the result is the one that all rounds give, within it."""
    nodes = spark.createDataFrame([("v", x) for x in "abcd"], "vault string, node string")
    edges = spark.createDataFrame([("v", "a", "b"), ("v", "b", "c"), ("v", "c", "a"), ("v", "d", "a")], "vault string, src string, dst string")
    early = {r["node"]: r["rank"] for r in graph.pagerank(nodes, edges, rounds=200, tolerance=1e-3).collect()}
    whole = {r["node"]: r["rank"] for r in graph.pagerank(nodes, edges, rounds=60, tolerance=0.0).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(60):
        rank = {x: 0.15 / 4 + 0.85 * sum(rank[s] / 1 for s, d in ("ab", "bc", "ca", "da") if d == x) for x in "abcd"}
    assert whole == pytest.approx(rank, abs=1e-9) and early == pytest.approx(rank, abs=5e-3) and early != whole


def test_versions_and_replays(spark, tmp_path):
    store = index.SnapshotStore(spark, f"file://{tmp_path}/s")
    row = lambda v: spark.createDataFrame([(1, v)], "path long, v string")
    assert store.current() is None and store.clear() is None
    assert store.publish(row("a"), 5) == 5 and store.publish(row("old"), 4) == 4 and store.read().first()["v"] == "a"
    assert store.publish(row("b")) == 6 and store.read().first()["v"] == "b"
    store.clear()
    assert store.read().count() == 0
    os.remove(next(str(p) for p in (tmp_path / "s" / "_pointer").iterdir() if p.name.startswith("part")))
    (tmp_path / "s" / "_pointer" / "part-broken.json").mkdir()
    with pytest.raises(Exception):  # a pointer that can't be read is no empty index
        store.publish(row("c"))
        if store.read().first()["v"] == "c":
            raise AssertionError("published over an unreadable pointer")


def test_change_log(spark, tmp_path):
    log = index.ChangeLog(spark, f"file://{tmp_path}/log", "key", "seq")
    batch = lambda *rows: spark.createDataFrame(list(rows), "key long, seq long, kind string")
    state = lambda: sorted(map(tuple, log.rows().collect()))
    assert log.rows() is None and log.compact() is None
    log.append(batch((1, 1, "put"), (2, 2, "put")), 0)
    log.append(batch((1, 5, "delete"), (3, 3, "put")), 1)
    want = [(1, 5, "delete"), (2, 2, "put"), (3, 3, "put")]
    assert state() == want
    log.append(batch((1, 5, "delete"), (3, 3, "put")), 1)  # a replay
    assert state() == want and log.compact() == 1 and state() == want
    log.append(batch((2, 9, "put"), (3, 1, "late")), 2)
    assert state() == [(1, 5, "delete"), (2, 9, "put"), (3, 3, "put")]


def test_index_build(spark, tmp_path):
    """Only what differs is embedded; nothing is published if nothing differs; broken blocks fail the write."""
    store = index.SnapshotStore(spark, f"file://{tmp_path}/i")
    docs = lambda **t: spark.createDataFrame(list(t.items()), "path string, text string")
    long = "# Head\n" + "word " * 900 + "\n# Head\nmore\n"
    states = lambda d, **o: {r["path"]: (r["state"], r["chunks"]) for r in index.build_index(d, store, **o).collect()}
    first = states(docs(a="one", b=long, c=""))
    assert first["a"] == ("new", 1) and first["b"][0] == "new" and first["b"][1] > 2 and "c" not in first
    assert {s for s, _ in states(docs(a="one", b=long)).values()} == {"same"} and store.current() == 0
    again = states(docs(a="two", d="four"))
    assert again == {"a": ("changed", 1), "d": ("new", 1), "b": ("gone", first["b"][1])} and store.current() == 1
    assert sorted(r["path"] for r in store.read().collect()) == ["a", "d"]
    assert {s for s, _ in states(docs(a="two", d="four"), model="other").values()} == {"changed"}
    none = lambda texts: np.zeros((len(texts), 0), dtype=np.float32)
    with pytest.raises(Exception, match="empty vector"):
        index.build_index(docs(a="three"), store, embedder=none)
    twice = store.read().unionByName(store.read())
    with pytest.raises(Exception, match="block twice"):
        index.checked_blocks(twice).collect()
    assert store.current() == 2


def test_postings(spark, tmp_path):
    rows = [(1, "n/a.md", "Café au lait, café-crème"), (2, "n/b.md", "cafe"), (3, "cafe/c.md", "nothing"), (4, "n/d.md", None), (5, "n/e.md", "crème then café")]
    docs = spark.createDataFrame(rows, "id long, file string, text string")
    path = f"file://{tmp_path}/p"
    write_postings(docs, path, ["id"], ["file", "text"])
    found = lambda q, **o: [r["id"] for r in search_postings(spark, path, q, ["id"], **o).collect()]
    assert set(found("Cafe")) == {1, 2, 3, 5} and found("cafe-creme") == [1] and found("md cafe nothing") == [3]
    assert found("absent") == [] and found("!!") == [] and set(found("cafe", cohort=docs.where("id > 2"))) == {3, 5}
    assert found("md-nothing") == []  # no phrase spans two columns
    assert bare("Ünïcødé") == "Unicøde" and phrases_of("\"a-b\" c' c d_e") == [["a", "b"], ["c"], ["d", "e"]]
    assert spark.range(1).select(tokens(F.lit("Ab, Éé 3x")).alias("t")).first()["t"] == ["ab", "ee", "3x"]


def test_search_many(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, [0.0] * 8), (401, [1.0, 2.0]), (500, [2.0, 1.0]), (402, [float("nan")] * 8), (403, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for block in (1000, 2):
        got: dict = {}
        for r in retrieval.search_many(frame, frame.where("vec_id % 100 = 0"), limit=4, block=block).collect():
            got.setdefault(r["query"], []).append((-r["similarity"], r["vec_id"]))
        for i, v in rows:
            if i % 100 == 0:
                unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
                others = sorted((-round(float(unit(v) @ unit(w)), 9), k) for k, w in rows if k != i and len(w) == len(v) and not np.isnan(w).any())
                assert [k for _, k in sorted(got[i])] == [k for _, k in others[:4]], i


def test_expansion():
    assert retrieval.expand("q", lambda q: [" one wording ", "abc", "x" * 300, "another", "third"]) == ["q", "one wording", "another"]
    assert retrieval.expand("q", lambda q: 1 / 0) == ["q"] == retrieval.expand("q")
    assert retrieval.texts_of("q", lambda q: ["more of it"], "an answer") == (["q", "more of it", "an answer"], ["q", "more of it"])
    assert retrieval.texts_of("q", None, "  ") == (["q"], ["q"])


def test_given_graphs(spark):
    obj = '{"resolved": {"a.md": {"b.md": 2}}, "unresolved": {"a.md": {"x": 1}}}'
    texts = [obj, '"' + obj.replace('"', '\\"') + '"', f"=> {obj} ok", "no braces", '{"broken": ']
    for i, t in enumerate(texts):
        edges, missing = edges_from_json(spark.createDataFrame([("v", t)], "vault string, json string"))
        assert edges.count() == missing.count() == (1 if i < 3 else 0), t
    given, parsed = spark.range(1), spark.range(2)
    assert select_provider(parsed, given)[1] == {"provider": "given", "approximate": False, "probe": "available", "reason": None}
    assert select_provider(parsed, given, disabled=True)[1]["reason"] == "disabled"
    assert select_provider(parsed, given, "cli_unavailable")[0] is parsed and select_provider(parsed, None)[1]["reason"] == "nothing_given"


def test_uri_plus(spark):
    head = f"{uris.SCHEME}://open?vault=v&file="
    rows = spark.createDataFrame([(head + x,) for x in ("My+Note", "My%2BNote", "a%FF", "a%EF%BF%BD", "b")], "uri string")
    got = {r["uri"][len(head) :]: (r["uri_file"], set(r["codes"])) for r in uris.parse(rows).collect()}
    assert got["My+Note"][0] == "My Note" and "raw_plus_as_space" in got["My+Note"][1] and got["My%2BNote"][0] == "My+Note"
    assert "malformed_percent_encoding" in got["a%FF"][1] and got["a%EF%BF%BD"][0] == "a�" and got["b"] == ("b", set())


def test_name_hints_are_bounded(spark):
    names = spark.createDataFrame([("note one",), ("x" * 200,), ("a b " * 20,), ("note two",)], "name string")
    assert [r["name"] for r in links.closest(names, "note on").collect()] == ["note one", "note two"]
    assert links.closest(names, "x" * 200).count() == 0 and links.closest(names, "a b " * 20).count() == 0


def test_scans_survive(spark, tmp_path):
    for name, text in {"a.md": "A", "d/b.md": "B" * 50, "t.base": "x", ".o/u.base": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "d/c.md").write_text("C" * 9)
    (tmp_path / "d/.c.md.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\0\0\0\0")  # listed, but reading it fails
    rows = scan_markdown(spark, str(tmp_path), "v", max_bytes=20)
    got = {r["path"]: (r["raw"], r["skipped"]) for r in rows.collect()}
    assert got == {"a.md": ("A", None), "d/b.md": (None, "too_large"), "d/c.md": (None, "unreadable")}
    assert scan_report(rows).as_dict()["reasons"] == ("too_large", "unreadable")
    assert [r["path"] for r in list_bases(spark, str(tmp_path)).collect()] == ["t.base"]


def test_first_backlink(spark):
    raw = "x" * 150 + "\nsee [[Old#h|x]] and\n\n[[New|shown]] " + "y" * 200
    notes = spark.createDataFrame([("v", "a.md", raw), ("v", "New.md", "[[New]]")], "vault string, path string, raw string")
    row = links.backlink_places(notes, "New.md").collect()
    assert len(row) == 1 and row[0]["line_no"] == 4 and row[0]["context"].startswith("...x") and row[0]["context"].endswith("y...") and " and [[New|shown]] y" in row[0]["context"]


def test_kept_signals_know_their_graph(spark, tmp_path):
    """Two graphs over the same notes give two results; a folder without a receipt isn't read."""
    import shutil

    from kgspark.functions.notes import parse_notes
    from kgspark.operators.graph import kept_signals

    notes = parse_notes(spark.createDataFrame([("v", f"{n}.md", "text", 0) for n in "abc"], "vault string, path string, raw string, mtime long"))
    links = lambda *pairs: spark.createDataFrame([("v", f"{a}.md", f"{b}.md", 1) for a, b in pairs], "vault string, src string, dst string, cnt long")
    into = lambda df: {r["node"]: r["in_degree"] for r in df.collect()}
    root, parsed = str(tmp_path), links("ab")
    assert into(kept_signals(notes, lambda: parsed, root)) == {"a.md": 0, "b.md": 1, "c.md": 0}
    assert into(kept_signals(notes, lambda: parsed, root, given=links("ca", "ba"))) == {"a.md": 2, "b.md": 0, "c.md": 0}
    assert into(kept_signals(notes, lambda: parsed, root, given=links("ca"))) == {"a.md": 1, "b.md": 0, "c.md": 0}
    assert into(kept_signals(notes, None, root, given=None)) == {"a.md": 0, "b.md": 1, "c.md": 0}
    assert into(kept_signals(notes, lambda: parsed, root, given=links("ca"), status="app_unavailable")) == {"a.md": 0, "b.md": 1, "c.md": 0}
    for done in tmp_path.glob("*/receipt"):
        shutil.rmtree(done)
    with pytest.raises(TypeError):
        kept_signals(notes, None, root)  # nothing counts as kept any more


def test_chunks_of_a_large_section_are_linear():
    import time

    from kgspark.functions.chunks import chunk

    began, text = time.perf_counter(), "word é line\n" * 800_000
    rows = chunk(text)
    assert "".join(r[2] for r in rows) == text and max(len(r[1].encode()) for r in rows) <= 2048
    assert time.perf_counter() - began < 20
    assert [r[2] for r in chunk("🙂" * 30, 17)][0] == "🙂" * 4


def test_search_leaves_blocks_unread(spark, tmp_path):
    """The best rows are those of reading everything, ties and cohorts included, from fewer rows."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", *[f"w{k}" for k in range(300)]]
    texts = [" ".join(rng.choices(words, weights=[40, 8, 1, *[2] * 300], k=int(2 ** rng.uniform(1, 9)))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:40], None, ""])], "id long, text string")
    path = f"{tmp_path}/p"
    write_postings(docs, path, ["id"], ["text"], block_rows=32)
    cohort, less = docs.where("id % 3 = 0"), 0
    for query in ("alpha", "alpha beta", "gamma alpha", "alpha beta gamma", "absent alpha"):
        for some in (None, cohort):
            whole = [(r["id"], round(r["score"], 9)) for r in search_postings(spark, path, query, ["id"], some, None).collect()]
            found, report = search_blocks(spark, path, query, ["id"], some, 7, first=2)
            assert [(r["id"], round(r["score"], 9)) for r in found.collect()] == whole[:7]
            assert report["read"] <= report["rows"]
            less += report["read"] < report["rows"]
    assert less >= 6
    few, report = search_blocks(spark, path, "gamma", ["id"], cohort.limit(0), 5)
    assert few.count() == 0 and report["read_blocks"] == report["blocks"]


def test_rank_rounds_leave_out_nodes_without_edges(spark, monkeypatch):
    """Rounds keep only nodes with edges; the others' common rank is right, also in a vault that has no edge at all."""
    sizes, stage = {}, graph.stage

    def seen(df, name):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(graph, "stage", seen)
    nodes = spark.createDataFrame([("v", str(i)) for i in range(40)] + [("w", "x"), ("w", "y")], "vault string, node string")
    edges = spark.createDataFrame([("v", "0", "1"), ("v", "1", "2"), ("v", "3", "1")], "vault string, src string, dst string")
    got = {(r["vault"], r["node"]): r["rank"] for r in graph.pagerank(nodes, edges, rounds=6, tolerance=0.0).collect()}
    rank = dict.fromkeys(range(40), 1 / 40)
    for _ in range(6):
        loose = sum(v for k, v in rank.items() if k not in (0, 1, 3))
        rank = {k: (0.15 + 0.85 * loose) / 40 + 0.85 * sum(rank[s] for s, d in ((0, 1), (1, 2), (3, 1)) if d == k) for k in rank}
    assert got == pytest.approx({("v", str(k)): v for k, v in rank.items()} | {("w", "x"): 0.5, ("w", "y"): 0.5}, abs=1e-12)
    assert sizes["rank"] == 4


def test_signals_parse_notes_once(spark):
    """Metadata is parsed for each note once, not for every step that asks what is excluded."""
    from kgspark.functions.notes import parse_notes

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        seen.add(1)
        return raw

    texts = spark.createDataFrame([("v", f"{n}.md", f"---\nnode_type: {'log' if n == 'd' else 'x'}\n---\ntext", 0) for n in "abcd"], "vault string, path string, raw string, mtime long")
    edges = spark.createDataFrame([("v", "a.md", "b.md", 1), ("v", "d.md", "c.md", 1)], "vault string, src string, dst string, cnt long")
    rows = {r["node"]: (r["in_degree"], r["excluded"]) for r in graph.signals(parse_notes(texts.withColumn("raw", counted("raw"))), edges).collect()}
    assert rows == {"a.md": (0, False), "b.md": (1, False), "c.md": (1, False), "d.md": (0, True)} and seen.value <= 4


def test_postings_take_one_shuffle(spark, tmp_path, monkeypatch):
    """Places are gathered where the text is: nothing is shuffled or written ahead of the stored postings."""
    from kgspark.operators import postings

    docs = spark.createDataFrame([(1, "b a B", "x"), (2, None, ""), (3, "Å", None), (4, "", "a z a")], "id long, file string, text string")
    rows = postings.postings(docs, ["id"], ["file", "text"])
    got = sorted((r["id"], r["term"], r["length"], r["at"]) for r in rows.collect())
    assert got == [(1, "a", 4, [1]), (1, "b", 4, [0, 2]), (1, "x", 4, [4]), (3, "a", 1, [0]), (4, "a", 3, [1, 3]), (4, "z", 3, [2])]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()

    def never(df, name):
        raise AssertionError(f"{name} written")

    monkeypatch.setattr(postings, "stage", never)
    write_postings(docs, f"{tmp_path}/p", ["id"], ["file", "text"])
    assert tuple(spark.read.parquet(f"{tmp_path}/p/totals").first()) == (4, 8) and spark.read.parquet(f"{tmp_path}/p/terms").count() == 6
