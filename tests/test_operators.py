"""Operators on small collections."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_functions import notes_of

from kgspark.functions.notes import parse_notes
from kgspark.operators import edits, graph, health, index, links, retrieval, search
from kgspark.operators.predicates import Condition, condition, query_notes


def test_resolution_order(spark):
    files = {"Note.md": "", "sub/Note.md": "", "sub/src.md": "[[Note]] [[other]] [[wrong/dir/Deep]] [[image.png]] [[#h]] [[Note#x]]", "a/b/Other.md": "", "z/Other.md": "", "q/Deep.md": ""}
    got = {r["ord"]: r["dst"] for r in links.resolved_links(notes_of(spark, files)).collect()}
    assert got == {0: "Note.md", 1: "z/Other.md", 2: "q/Deep.md", 3: None, 4: None, 5: "Note.md"}


def test_hub_and_leaves(spark):
    files = {"hub.md": "", "mid.md": "[[hub]]"} | {f"leaf{i}.md": "[[hub]] ![[hub]] [[mid]] [[nope]]" for i in range(8)}
    files |= {f"gen{i}.md": "---\nnode_type: generated\n---\n[[hub]]" for i in range(5)}
    notes = parse_notes(notes_of(spark, files))
    edges = links.edges(links.resolved_links(notes))
    rows = {r["node"]: r for r in graph.signals(notes, edges).collect()}
    assert rows["hub.md"]["in_degree"] == 14 and rows["hub.md"]["level"] == 0 and rows["gen0.md"]["excluded"] and rows["gen0.md"]["level"] is None
    assert all(rows[f"leaf{i}.md"]["level"] == 5 for i in range(8))
    assert {r["cnt"] for r in edges.where("dst = 'hub.md' and src like 'leaf%'").collect()} == {2}
    assert sum(r["rank"] for r in rows.values() if r["rank"]) == pytest.approx(1)
    assert graph.excluded(notes, []).count() == 0


def test_pagerank_against_plain_python(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    nodes = "abcde"
    rank = dict.fromkeys(nodes, 1 / 5)
    outs = {n: [y for x, y in pairs if x == n] for n in nodes}
    for _ in range(20):
        loose = sum(rank[n] for n in nodes if not outs[n])
        new = {n: 0.15 / 5 + 0.85 * (sum(rank[x] / len(outs[x]) for x, y in pairs if y == n) + loose / 5) for n in nodes}
        moved, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if moved < 1e-7:
            break
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = graph.pagerank(frame([("v", n) for n in nodes], "vault string, node string"), frame([("v", *p) for p in pairs], "vault string, src string, dst string"))
    assert {r["node"]: pytest.approx(r["rank"], abs=1e-9) for r in got.collect()} == rank


def test_percentile_levels(spark):
    ranked = spark.createDataFrame([("v", f"n{i}", float(i + 1)) for i in range(30)], "vault string, node string, rank double")
    degree = spark.createDataFrame([("v", f"n{i}", 0 if i == 5 else 1) for i in range(30)], "vault string, node string, in_degree long")
    got = {r["node"]: r["level"] for r in graph.levels(ranked, degree).collect()}
    assert got["n29"] == 0 and got["n0"] == 4 and got["n5"] == 5


@pytest.mark.parametrize(
    "op, field, value, want",
    [
        ("equals", "s", "ACTIVE", {"a"}), ("not_equals", "s", "active", {"b", "c"}), ("equals", "l", "x", {"a"}), ("equals", "l", "X", set()), ("equals", "none", "undefined", {"a", "b", "c"}),
        ("contains", "s", "CT", {"a"}), ("contains", "l", "Y", {"a"}), ("not_contains", "n", "1", {"b", "c"}), ("in", "n", ["10"], {"a"}), ("in", "l", ["x,y"], {"a"}), ("not_in", "s", "draft", {"a", "c"}),
        ("exists", "n", None, {"a", "b"}), ("not_exists", "n", None, {"c"}), ("greater_than", "n", 5, {"a"}), ("less_than", "n", "5", {"b"}), ("greater_than", "s", "b", {"b"}), ("odd", "n", 1, {"a", "b", "c"}),
    ],
)
def test_predicates(spark, op, field, value, want):
    files = {"a.md": "---\ns: Active\nn: 10\nl: [x, y]\n---\n", "b.md": "---\ns: draft\nn: 2\n---\n", "c.md": "plain"}
    notes = parse_notes(notes_of(spark, files))
    got = {r["path"][0] for r in notes.where(condition(Condition(field, op, value))).collect()}
    assert got == want


def test_sorting_is_by_text(spark):
    files = {f"P/{i}.md": f"---\nn: {i}\n---\n" for i in (2, 10, 1)} | {"root.md": "---\nn: 0\n---\n"}
    notes = parse_notes(notes_of(spark, files))
    assert [r["n"] for r in query_notes(notes, start="P", fields=["n"], sort_by="n").collect()] == ["1", "10", "2"]
    assert [r["n"] for r in query_notes(notes, fields=["n"], sort_by="-n", limit=2).collect()] == ["2", "10"]


def test_health(spark):
    files = {"root.md": "[[hub]]", "d/hub.md": "[[d/linked]] [[gone]] [[gone]]\n![[gone]] [[gone2]]", "d/linked.md": "", "d/orphan.md": "[[hub#h]]"}
    notes = notes_of(spark, files)
    resolved = links.resolved_links(notes, "raw", "target")
    assert {r["path"] for r in health.orphans(notes, resolved).collect()} == {"root.md", "d/orphan.md"}
    assert {r["path"] for r in health.orphans_below_root(notes, resolved).collect()} == {"d/orphan.md"}
    assert {r["path"] for r in health.orphans_by_name(notes).collect()} == {"root.md", "d/orphan.md"}
    assert {r["path"] for r in health.dead_ends(notes).collect()} == {"d/linked.md"}
    places = sorted((r["path"], r["line_no"], r["index_on_line"], r["target"]) for r in health.broken_places(notes).collect())
    assert places == [("d/hub.md", 1, 1, "gone"), ("d/hub.md", 1, 2, "gone"), ("d/hub.md", 2, 0, "gone"), ("d/hub.md", 2, 1, "gone2"), ("d/orphan.md", 1, 0, "hub#h")]
    old = notes.withColumn("mtime", F.lit(dt.datetime(2024, 1, 1)))
    assert {r["days"] for r in health.stale(old, dt.datetime(2024, 7, 19)).collect()} == {200}
    assert health.stale(old, dt.datetime(2024, 3, 1)).count() == 0


def test_fusion_and_metrics(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r["id"]: r["fusion"] for r in retrieval.fuse({"x": one, "y": two}, "id").collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61), "c": pytest.approx(1 / 62)}
    gold = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["x", "a"], ["a"]), (3, ["a", "q", "b"], ["a", "b"]), (4, ["x"], ["y"]), (5, [], [])], "query_id int, ranked array<string>, relevant array<string>")
    rows = {r["query_id"]: r for r in retrieval.evaluate(gold, 3).collect()}
    assert [rows[i]["rr"] for i in range(1, 6)] == [1, 0.5, 1, 0, 0] and rows[3]["recall"] == 1 and rows[1]["precision"] == pytest.approx(1 / 3)
    long = gold.select("query_id", F.posexplode("ranked").alias("rank", "item")).withColumn("rank", F.col("rank") + 1)
    by_rows = {r["query_id"]: r for r in retrieval.evaluate_rows(long, gold.select("query_id", F.explode("relevant").alias("item")), 3).collect()}
    assert all(by_rows[i][c] == pytest.approx(rows[i][c]) for i in range(1, 5) for c in ("recall", "precision", "ndcg", "rr"))
    assert rows[3]["ndcg"] == pytest.approx((1 + 0.5) / (1 + 0.6309297535714575)) and rows[5]["ndcg"] == 0


def test_reciprocal_rank_sees_the_whole_ranking(spark):
    ranking = spark.range(1, 1001).select(F.lit("q").alias("query_id"), F.col("id").alias("item"), F.col("id").alias("rank"))
    relevant = spark.createDataFrame([("q", 700), ("q", 251), ("q", 5000), ("other", 1)], "query_id string, item long")
    row = retrieval.evaluate_rows(ranking, relevant, 10).collect()
    assert [(r["query_id"], r["rr"], r["recall"], r["precision"], r["ndcg"]) for r in row] == [("q", 1 / 251, 0, 0, 0)]


def test_source_rankings_are_whole(spark, tmp_path):
    """The first junk document of a source stands at rank 151 of 200."""
    from kgspark.plans import catalogue

    docs = [(i, "s", 1000 - i) for i in range(1, 201)] + [(i, "t", 1000 - i) for i in range(201, 205)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(151, 0), (160, 0), (1, 1), (202, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rr = {r["query_id"]: r["rr"] for r in catalogue.queries()["eval_by_query"](spark, str(tmp_path)).collect()}
    assert rr == {"s": pytest.approx(1 / 151, abs=1e-6), "t": 0.5}
    mrr = catalogue.queries()["eval_summary"](spark, str(tmp_path)).first()["mrr"]
    assert mrr == pytest.approx((1 / 151 + 0.5) / 2, abs=1e-6)


def test_every_document_has_a_preview(spark, tmp_path):
    from kgspark.plans import catalogue

    rows = [(i, f"text  of\n{i}") for i in (1, 49, 50, 51, 100)] + [(None, "no id"), (2, "x" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["preview"] for r in catalogue.queries()["result_previews"](spark, str(tmp_path)).collect()}
    assert got == {i: f"text of {i}" for i in (1, 49, 50, 51, 100)} | {None: "no id", 2: "x" * 200 + "..."}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], round(r["similarity"], 4)) for r in retrieval.vector_search(rows, [1.0, 0.0]).collect()]
    assert got == [(1, 1.0), (2, 0.7071), (3, 0.0)]
    assert [r["vec_id"] for r in retrieval.similar(rows, 1, limit=1).collect()] == [2] and retrieval.similar(rows, 99).count() == 0


def test_bm25_like_sqlite(spark):
    import sqlite3

    texts = ["apple pie and apple tart", "pear pie", "apple", "a long text about nothing in particular but apple and pie", "plum"] * 3
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(c)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    db.executemany("insert into t(rowid, c) values (?, ?)", enumerate(texts, 1))
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    for q in ("pear", "plum", "nothing"):
        want = {r[0]: -r[1] for r in db.execute("select rowid, bm25(t) from t where t match ?", (q,))}
        got = {r["doc_id"]: r["score"] for r in search.keyword_search(docs, q, limit=None).collect()}
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_rerank(spark):
    rows = spark.createDataFrame([(i, i) for i in range(1, 5)], "id long, rank int")
    retrieval.register_reranker("t", lambda q, r: {3: 0.9, 2: 0.1})
    retrieval.register_reranker("bad", lambda q, r: 1 / 0)
    assert [r["id"] for r in retrieval.rerank(rows, "q", "id", "t")[0].orderBy("rank").collect()] == [3, 2, 1, 4]
    assert retrieval.rerank(rows, "q", "id", "bad")[1] == "failed: ZeroDivisionError" and retrieval.rerank(rows, "q", "id")[1] == "none"


def test_coverage_percent(spark):
    rows = spark.createDataFrame([(0, 10), (1, 100000), (99999, 100000), (2, 2), (1000001, 1000000), (2, 1)], "a long, b long")
    assert [r[0] for r in rows.select(index.percent(F.col("a"), F.col("b"))).collect()] == [0, 0.01, 99.99, 100, 100.01, 200]


def test_snapshots(spark, tmp_path):
    store = index.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None
    store.publish(spark.createDataFrame([(1, "a"), (2, "b")], "path long, v string"))
    fresh, gone = spark.createDataFrame([(2, "c")], "path long, v string"), spark.createDataFrame([(1,)], "path long")
    store.publish(index.merge(store.read(), fresh, gone))
    assert [tuple(r) for r in store.read().collect()] == [(2, "c")]


def test_sections():
    text = "# A\none\n## B\ntwo\n## C\nthree\n"
    assert edits.edit_section(text, "b", "new", "append") == "# A\none\n## B\ntwo\n\nnew\n\n## C\nthree\n"
    assert edits.edit_section(text, "## B", "new", "prepend") == "# A\none\n## B\nnew\n\ntwo\n## C\nthree\n"
    assert edits.edit_section(text, "A", "new", "replace") == "# A\nnew\n" and edits.edit_section(text, "Z", "new", "append") == text


def test_edits(spark):
    notes = notes_of(spark, {"a.md": "see [[Old#h|x]] [[old]] [[Older]]", "Old.md": "- [ ] t"})
    moved = {r["path"]: r["raw"] for r in edits.move(notes, "Old.md", "New.md").collect()}
    assert moved["a.md"] == "see [[New#h|x]] [[New]] [[Older]]" and "New.md" in moved
    assert {r[0] for r in notes.select(edits.toggle_task("raw", 1)).collect()} == {"see [[Old#h|x]] [[old]] [[Older]]", "- [x] t"}
    with pytest.raises(FileExistsError):
        edits.create(notes, "a.md", "", "v")


def test_search(spark):
    notes = notes_of(spark, {"a.md": "Hello\n hello hello \nbye", "b.md": "nothing"})
    rows = search.search_lines(notes, "hello").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"], r["matches"]) for r in rows] == [(1, "Hello", 1), (2, "hello hello", 2)]
    assert search.search_context(notes, "HELLO").first()["lines"] == ["Hello", "hello hello"]
    assert [r["exact"] for r in search.find_by_name(notes_of(spark, {"x/Ab.md": "", "Abc.md": ""}), "AB").collect()] == [True, False]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controll", "control"), ("sky", "sky"), ("licensing", "licens")])
def test_stems(word, want):
    from kgspark.functions.stem import stem

    assert stem(word) == want


def test_beside_results(spark):
    from kgspark.operators import annotate, daily

    hits = notes_of(spark, {"Café.md": "", "x.md": ""}).select("vault", "path")
    signals = spark.createDataFrame([("v", "Café.md", 3), ("w", "x.md", 4)], "vault string, path string, n int")
    assert {r["path"]: r["graph"] and r["graph"]["n"] for r in annotate.with_signals(hits, signals).collect()} == {"Café.md": 3, "x.md": None}
    texts = ["a \n b", "x" * 300, "x" * 199 + "🙂y", "🙂" * 150, "🙂" * 100, "x" * 198 + "🙂y"]
    text = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(annotate.preview(F.col("t")).alias("p")).collect()]
    assert text == ["a b", "x" * 200 + "...", "x" * 199 + "...", "🙂" * 100 + "...", "🙂" * 100, "x" * 198 + "🙂..."]
    assert annotate.Completeness.exact(5, 3).as_dict() == {"state": "exact", "total": 5, "returned": 3, "truncated": True, "has_more": True}
    assert annotate.Completeness.of_limited(11, 10).state == "limit_reached" and annotate.Completeness.partial(3, 2, ["a"] * 20).reasons == ("a",)
    at = F.lit(dt.datetime(2024, 3, 5, 7, 8, 9))
    row = spark.range(1).select(daily.daily_path(at, "/J/", "YYYY/MM-DD HHmmss").alias("p")).first()
    assert row["p"] == "J/2024/03-05 070809.md"
    a, b = notes_of(spark, {"a": "1", "b": "2"}), notes_of(spark, {"b": "2", "a": "1"})
    assert annotate.digest(a, ["vault"]).first() == annotate.digest(b, ["vault"]).first() != annotate.digest(notes_of(spark, {"a": "2", "b": "1"}), ["vault"]).first()


def test_catalog():
    from kgspark.catalog import discover

    page = discover(5, 0)
    assert len(page["entries"]) == 5 and page["has_more"] and sum(page["groups"].values()) == page["total"]
