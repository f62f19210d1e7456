"""Queries of whole flows: building an index, stored postings, expanded search, kept graphs, sections, daily notes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from kgspark.functions.links import unresolved_key
from kgspark.functions.notes import parse_notes, sections, with_path_parts
from kgspark.functions.uris import SCHEME, uri_places
from kgspark.operators import graph, index, retrieval
from kgspark.operators.daily import daily_add
from kgspark.operators.edits import replace_body
from kgspark.operators.links import backlink_places, closest_all, resolved_links
from kgspark.operators.links import edges as edges_of
from kgspark.operators.postings import search_postings, write_postings
from kgspark.operators.search import keyword_search
from kgspark.plans.base import EDGES, FILES, LINKS, NOTES, VAULT_NOTES, all_links, linked, raw
from kgspark.plans.registry import mil, query
from kgspark.plans.search import bm25_sql
from kgspark.session import shared_dir, stage
from kgspark.sources.adjacency import edges_from_json, select_provider
from kgspark.sources.collection import table
from kgspark.sources.markdown import file_info, list_notes, read_notes
from kgspark.sources.note_writer import write_notes

_SIX = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "index_build",
    "SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'gone' WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents "
    "WHERE text <> '' AND (doc_id % 13 <> 0 OR doc_id % 10 <> 0)",
)
def index_build(spark, d):
    """An index of an older state of the documents, brought up to date: what each file's state was."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text").where("text <> ''")
    older = docs.where("path % 10 <> 0").withColumn("text", F.expr("CASE WHEN path % 7 = 0 THEN text || ' an older end' ELSE text END"))
    store = index.SnapshotStore(spark, _new(spark, "index"))
    index.build_index(older, store)
    return index.build_index(docs.where("path % 13 <> 0"), store).select("path", "state")


@query("index_content", "SELECT doc_id AS path, strlen(text) AS bytes FROM documents WHERE text <> '' AND doc_id % 13 <> 0")
def index_content(spark, d):
    """What the index holds after an update: the chunks of each file join to its text, each with a vector."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text").where("text <> ''")
    store = index.SnapshotStore(spark, _new(spark, "index"))
    index.build_index(docs.where("path % 10 <> 0").withColumn("text", F.concat("text", F.lit("."))), store)
    index.build_index(docs.where("path % 13 <> 0"), store)
    rows = store.read().where(retrieval.valid_vector())
    return rows.groupBy("path").agg(F.sum(F.octet_length("source_text")).alias("bytes"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents(x)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_COLUMNS = "list_concat(" + _TOKENS.replace("x)", "file)") + ", [''], " + _TOKENS.replace("x)", "coalesce(text, ''))") + ")"


def postings_sql(phrases: list[list[str]], cohort: str, limit: int = 10) -> str:
    def hits(p: list[str]) -> str:
        return "len(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{t}'" if k else f"w[i] = '{t}'" for k, t in enumerate(p)) + "))"

    f = ", ".join(f"{hits(p)} AS f{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(phrases)))
    return (
        f"WITH c AS (SELECT doc_id, 'docs/' || source || '/n' || doc_id AS file, text FROM documents), w AS (SELECT doc_id, {_COLUMNS} AS w FROM c), tf AS (SELECT doc_id, len(w) - 1 AS dl, {f} FROM w), "
        f"st AS (SELECT count(*) AS n, avg(dl) AS av, {n} FROM tf) SELECT doc_id, {mil(f'CAST({score} AS DOUBLE)')} AS score FROM tf CROSS JOIN st WHERE {' AND '.join(f'f{i} > 0' for i in range(len(phrases)))} AND {cohort} ORDER BY CAST({score} AS DOUBLE) DESC, doc_id LIMIT {limit}"
    )


def _search(spark, d, text: str, cohort: str, limit: int = 10):
    docs = table(spark, d, "documents").withColumn("file", F.concat(F.lit("docs/"), F.col("source"), F.lit("/n"), F.col("doc_id").cast("string")))
    path = _new(spark, "postings")
    write_postings(docs.select("doc_id", "file", "text"), path, ["doc_id"], ["file", "text"])
    return search_postings(spark, path, text, ["doc_id"], docs.where(cohort), limit).select("doc_id", _SIX("score").alias("score"))


@query("postings_search", postings_sql([["apache"], ["license"], ["docs"]], "doc_id % 3 <> 0"))
def postings_search(spark, d):
    """Keywords over stored postings, file names counted too, for the rows of one model's cohort."""
    return _search(spark, d, "'Apache' license, DOCS", "doc_id % 3 <> 0")


@query("postings_phrase", postings_sql([["apache", "license"], ["version"]], "TRUE", 50))
def postings_phrase(spark, d):
    return _search(spark, d, '"apache-license" version', "true", 50)


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@query(
    "vector_topk_many",
    f"SELECT query, vec_id, floor(similarity * 1e4 + 0.5) / 1e4 AS similarity FROM (SELECT q.vec_id AS query, e.vec_id, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS r "
    "FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE r <= 10",
)
def vector_topk_many(spark, d):
    """The ten nearest of every vector whose id is divisible by 100, against all."""
    vectors = table(spark, d, "embeddings")
    found = retrieval.search_many(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query", "vec_id", (F.floor(F.col("similarity") * 1e4 + 0.5) / 1e4).alias("similarity"))


@query("similar_files", f"SELECT e.label, {mil(f'max({_COS})')} AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 1) q WHERE e.label <> 3 AND {_COS} >= 0 GROUP BY 1 ORDER BY max({_COS}) DESC, label LIMIT 5")
def similar_files(spark, d):
    """A file (here: a label) stands for its lowest chunk; others for their nearest one."""
    found = retrieval.similar_files(table(spark, d, "embeddings"), 3, "label", "vec_id")
    return found.select("label", _SIX("similarity").alias("similarity"))


def _near(probe: int) -> str:
    return f"(SELECT e.vec_id, {_COS} AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {probe}) q WHERE {_COS} >= 0.1 ORDER BY similarity DESC, e.vec_id LIMIT 20)"


def _second(terms: list[str]) -> str:
    """The CTEs of a second keyword query, under names of their own."""
    sql = bm25_sql(terms, 20)
    for name in ("words", "tf", "st", "keyword"):
        sql = sql.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name})", f"FROM {name}2)").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"JOIN {name} ", f"JOIN {name}2 ")
    return sql


@query(
    "expanded_search",
    f"WITH {bm25_sql(['license'], 20)}, {_second(['apache', 'version'])}, "
    f"v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY max(round(similarity, 9)) DESC, vec_id) AS r FROM ({_near(0)} UNION ALL {_near(1)} UNION ALL {_near(2)}) GROUP BY vec_id), "
    "k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS r FROM (SELECT * FROM keyword UNION ALL SELECT * FROM keyword2) GROUP BY doc_id), "
    "f AS (SELECT coalesce(v.id, k.id) AS id, v.r AS vr, k.r AS kr, coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0) AS fusion FROM v FULL JOIN k ON v.id = k.id) "
    f"SELECT id, coalesce(vr, 0) AS vector_rank, coalesce(kr, 0) AS keyword_rank, {mil('fusion')} AS fusion FROM f ORDER BY f.fusion DESC, id LIMIT 10",
)
def expanded_search(spark, d):
    """One expansion and a hypothetical answer: three texts are embedded, the query and its expansion searched by keyword."""
    vectors, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    probes = {r["vec_id"]: r["embedding"] for r in vectors.where("vec_id < 3").collect()}
    embed = {"license": probes[0], "apache version": probes[1], "It is under a licence.": probes[2]}.__getitem__
    words = lambda t, n: keyword_search(docs, t, limit=n).withColumnRenamed("doc_id", "id")
    found = retrieval.hybrid(vectors.withColumnRenamed("vec_id", "id"), words, embed, "license", "id", least=0.1, expander=lambda q: ["apache version", "no"], hypothesis="It is under a licence.")
    rank = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return found.select("id", rank("vector_rank"), rank("keyword_rank"), _SIX("fusion").alias("fusion"))


@query(
    "backlinks_context",
    f"WITH {NOTES}, {LINKS}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS r, count(*) OVER (PARTITION BY path) AS n FROM links WHERE path <> 'nations/NATION_7.md' AND (lower(target) IN ('nations/nation_7.md', 'nations/nation_7', 'nation_7', 'nation_7.md') OR ends_with(lower(target), '/nation_7'))), "
    "p AS (SELECT n.path, l.n AS links, n.raw, m.m, strpos(n.raw, m.m) AS pos FROM l JOIN one m ON m.path = l.path AND m.ord = l.ord JOIN notes n ON n.path = l.path WHERE l.r = 1) "
    "SELECT path, links, CAST(len(string_split(substr(raw, 1, pos), chr(10))) AS BIGINT) AS line_no, trim(regexp_replace(CASE WHEN pos > 101 THEN '...' ELSE '' END || substr(raw, greatest(pos - 100, 1), least(pos + length(m) + 100, length(raw) + 1) - greatest(pos - 100, 1)) || CASE WHEN pos + length(m) + 100 <= length(raw) THEN '...' ELSE '' END, '\\s+', ' ', 'g')) AS context FROM p",
)
def backlinks_context(spark, d):
    rows = backlink_places(raw(spark, d), "nations/NATION_7.md")
    return rows.select("path", "links", F.col("line_no").cast("long").alias("line_no"), "context")


@query(
    "note_sections",
    f"WITH {NOTES}, l AS (SELECT path, unnest(string_split(raw, chr(10))) AS line, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS line_no FROM notes), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS head FROM l), "
    "k AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY path ORDER BY line_no) AS k FROM h), "
    "s AS (SELECT path, k, arg_min(line, line_no) AS heading, min(line_no) AS start_line, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY line_no), ''), ' ' || chr(10)) AS content FROM k GROUP BY path, k) "
    "SELECT path, CASE WHEN k > 0 THEN replace(lower(regexp_replace(heading, '^#+\\s+', '')), ' ', '-') ELSE '_preamble' END AS block_id, CASE WHEN k > 0 THEN heading ELSE '' END AS heading, start_line, content FROM s WHERE k > 0 OR length(content) > 50",
)
def note_sections(spark, d):
    return sections(raw(spark, d)).select("path", "block_id", "heading", F.col("start_line").cast("long").alias("start_line"), "content")


_AT = dt.datetime(1998, 8, 2)


def _daily(where: str, new: str):
    sql = f"WITH {NOTES} SELECT path, raw FROM notes UNION ALL SELECT 'Journal/1998-08-02.md', {new}"

    @query(f"daily_{where}", sql)
    def run(spark, d):
        return daily_add(raw(spark, d).select("vault", "path", "raw"), _AT, "Called.", "main", where, "Journal").select("path", "raw")


_daily("append", "chr(10) || 'Called.'")
_daily("prepend", "'Called.' || chr(10)")


@query("file_info", f"WITH {NOTES}, {FILES} SELECT n.path, f.name, 'md' AS extension, strlen(n.raw) AS size, epoch_ms(n.mtime) AS modified FROM notes n JOIN files f ON f.path = n.path")
def note_info(spark, d):
    return file_info(raw(spark, d)).select("path", "name", "extension", "size", "modified")


@query("body_replace", f"WITH {NOTES} SELECT path, regexp_extract(raw, '(?s)^---\\n.*?\\n---\\n') || 'All new.' AS raw FROM notes")
def body_replace(spark, d):
    return raw(spark, d).select("path", replace_body("raw", "All new.").alias("raw"))


@query("given_graph_quoted", linked(EDGES) + "SELECT src, dst, cnt FROM edges")
def given_graph_quoted(spark, d):
    """The other resolver's graph, quoted or with words around it, and chosen over the parsed one where it can be had."""
    edges = edges_of(all_links(spark, d))
    rows = edges.groupBy("vault", "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "cnt"))).alias("m"))
    text = F.to_json(F.struct(F.create_map("src", "m").alias("resolved")))
    quoted = F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    kind = F.pmod(F.xxhash64("src"), F.lit(3))
    shown = F.when(kind == 0, text).when(kind == 1, quoted).otherwise(F.concat(F.lit("=> "), text, F.lit(" done")))
    given = edges_from_json(rows.select("vault", shown.alias("json")))[0]
    return select_provider(edges, given)[0].select("src", "dst", "cnt")


_TURNED = """two AS (SELECT 'parsed' AS graph, vault, src, dst FROM edges UNION ALL SELECT 'given', vault, dst, src FROM edges),
tips AS (SELECT graph, vault, dst AS node, count(DISTINCT src) AS i, 0 AS o FROM two GROUP BY ALL UNION ALL SELECT graph, vault, src, 0, count(DISTINCT dst) FROM two GROUP BY ALL)"""


@query(
    "kept_degrees",
    linked(f"{EDGES}, {_TURNED}", notes=VAULT_NOTES)
    + "SELECT g.graph, n.vault, n.path AS node, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree FROM notes n CROSS JOIN (VALUES ('parsed'), ('given')) g(graph) "
    "LEFT JOIN tips t ON t.graph = g.graph AND t.vault = n.vault AND t.node = n.path GROUP BY ALL",
)
def kept_degrees(spark, d):
    """Signals of two graphs over the same notes, kept side by side: read again, each gives its own degrees."""
    texts = raw(spark, d, merged=False).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vault", "path")  # parsing is the work: all tasks share it
    notes = stage(parse_notes(texts).select("vault", "path", "raw", "props"), "notes")
    links = stage(edges_of(resolved_links(notes)), "edges")
    turned = links.select("vault", F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt")
    root = _new(spark, "signals")
    graph.kept_signals(notes, lambda: links, root)
    graph.kept_signals(notes, lambda: links, root, given=turned)

    def never():
        raise AssertionError("worked out twice")

    kept = {"parsed": graph.kept_signals(notes, never, root), "given": graph.kept_signals(notes, never, root, given=turned)}
    rows = [k.select(F.lit(name).alias("graph"), "vault", "node", "in_degree", "out_degree") for name, k in kept.items()]
    return rows[0].unionByName(rows[1])


_ASKED = """wanted AS (SELECT DISTINCT vault, trim(link_path) AS wanted FROM resolved WHERE dst IS NULL AND link_path <> '' UNION SELECT vault, replace(name, '_', '') || 'x' FROM files),
pairs AS (SELECT w.wanted, n.name, CAST(levenshtein(lower(n.name), lower(w.wanted)) AS INTEGER) AS distance FROM wanted w JOIN (SELECT DISTINCT vault, name FROM files) n ON n.vault = w.vault
  WHERE contains(lower(n.name), lower(w.wanted)) OR contains(lower(w.wanted), lower(n.name)) OR levenshtein(lower(n.name), lower(w.wanted)) <= 3)"""


@query("target_hints", linked(_ASKED) + "SELECT wanted, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY distance, name) AS r FROM pairs) WHERE r <= 3")
def target_hints(spark, d):
    """The nearest names of every missing link target at once, and of every note's name misspelled."""
    links = all_links(spark, d)
    missing = links.where("dst is null and link_vault is null and link_path <> ''").select("vault", unresolved_key(F.col("target")).alias("wanted"))
    names = with_path_parts(raw(spark, d)).select("vault", "name")
    wrong = names.select("vault", F.concat(F.replace("name", F.lit("_"), F.lit("")), F.lit("x")).alias("wanted"))
    return closest_all(names, missing.unionByName(wrong)).select("wanted", "name", "distance")


_URI = f"{SCHEME}://open?vault=v&file=c"


@query(
    "uri_positions",
    f"SELECT c_custkey, '{_URI}' || c_custkey AS uri, c_custkey % 7 + 4 AS line, 4 + 2 * (c_custkey % 5) AS col FROM customer "
    f"UNION ALL SELECT c_custkey, '{_URI}last', c_custkey % 7 + 6, 1 FROM customer WHERE c_custkey % 3 <> 0",
)
def uri_positions(spark, d):
    """Lines and columns of links to notes: behind fences, code spans and characters of two units."""
    k = F.col("c_custkey")
    link = lambda end: F.concat(F.lit(f"[it]({_URI}"), end, F.lit(")"))
    text = F.concat(
        F.repeat(F.lit("a line\n"), (k % 7).cast("int")), F.lit("~~~ md\n"), link(F.lit("fenced")), F.lit("\n~~~~\n`` "),  # a fence, then a code span that ends ahead of the link
        F.lit("``"), F.repeat(F.lit("\U0001F642"), (k % 5).cast("int")),
    )
    text = F.concat(F.regexp_replace(text, "`` ``", "-->"), link(k.cast("string")), F.lit(" `"), link(F.lit("code")), F.lit("`\n!"), link(F.lit("image")))
    text = F.concat(text, F.lit("\n"), F.when(k % 3 == 0, F.lit("```\n")).otherwise(F.lit("")), link(F.lit("last")))
    rows = table(spark, d, "customer").select("c_custkey", text.alias("raw"))
    return uri_places(rows, "raw", ("c_custkey",)).select("c_custkey", "uri", "line", "col")


@query("notes_written", f"WITH {NOTES} SELECT path, md5(CASE WHEN path LIKE '%7.md' THEN raw || chr(10) || 'written back' ELSE raw END) AS digest FROM notes")
def notes_written(spark, d):
    """Notes as files: all are written, a part is edited and written back, and the folder is read again."""
    root = _new(spark, "vault")
    write_notes(raw(spark, d), root)
    edited = read_notes(list_notes(spark, root).where(F.col("path").endswith("7.md")), root, "main")
    write_notes(edited.withColumn("raw", F.concat("raw", F.lit("\nwritten back"))), root)
    return read_notes(list_notes(spark, root), root, "main").select("path", F.md5("raw").alias("digest"))
