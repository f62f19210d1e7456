"""Expressions against hand-computed values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.functions import chunks, jslike
from kgspark.functions.links import link_places, wikilinks
from kgspark.functions.notes import outline, parse_front, parse_notes, tags, tasks
from kgspark.functions.uris import SCHEME, note_uris, parse


def notes_of(spark, files, vault="v"):
    return spark.createDataFrame([(vault, p, r) for p, r in files.items()], "vault string, path string, raw string")


def test_number_and_string_forms(spark):
    rows = spark.createDataFrame([('{"a": 5}',), ('{"a": "x"}',), ('{"a": true}',), ('{"a": null}',), ("{}",), ('{"a": ["p", 2, null]}',), ('{"a": 2.5}',)], "j string")
    v = jslike.field(F.parse_json("j"), "a")
    got = [r[0] for r in rows.select(jslike.js_string(v)).collect()]
    assert got == ["5", "x", "true", "null", "undefined", "p,2,", "2.5"]
    texts = ["", " 12 ", "0x10", "1e3", "abc", "-.5", " 7 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jslike.number_text(F.col("t"))).collect()]
    assert got == [0.0, 12.0, 16.0, 1000.0, None, -0.5, 7.0]


def test_unicode(spark):
    rows = spark.createDataFrame([("😀a",), (" x　",), ("é",)], "t string")
    got = rows.select(jslike.utf16_length(F.col("t")).alias("n"), jslike.trim(F.col("t")).alias("t"), jslike.nfc("t").alias("c")).collect()
    assert got[0]["n"] == 3 and got[1]["t"] == "x" and got[2]["c"] == "é"


def test_front_matter():
    assert parse_front("a: 1\nb: [x, y]") == '{"a": 1, "b": ["x", "y"]}' and parse_front("- 1") == parse_front(None) == parse_front(": [") == "{}"
    assert parse_front("d: 2024-01-02") == '{"d": "2024-01-02"}'


def test_notes(spark):
    files = {
        "a/One.md": "---\ntitle: Named\ntags: [t1, t2]\n---\n# Head\n\n- [ ] do #x\n* [X] done\n+ [ ] not\n## Sub\n",
        "Two.md": "text only #tag/sub and a#b\n# Late",
        "Three.md": "---\ntitle: 7\n---\nbody",
    }
    rows = {r["path"]: r for r in parse_notes(notes_of(spark, files)).collect()}
    assert rows["a/One.md"]["title"] == "Named" and rows["a/One.md"]["dir"] == "a" and rows["a/One.md"]["depth"] == 2
    assert rows["Two.md"]["title"] == "Late" and rows["Three.md"]["title"] == "Three" and rows["Three.md"]["body"] == "body"
    got = sorted((r["path"], r["line_no"], r["done"], r["task"]) for r in tasks(notes_of(spark, files)).collect())
    assert got == [("a/One.md", 7, False, "do #x"), ("a/One.md", 8, True, "done")]
    assert [r["shown"] for r in outline(notes_of(spark, files)).where("path like 'a%'").orderBy("line_no").collect()] == ["Head", "  Sub"]
    got = sorted((r["path"], r["tag"], r["origin"]) for r in tags(parse_notes(notes_of(spark, files))).collect())
    assert got == [("Two.md", "tag/sub", "inline"), ("a/One.md", "t1", "metadata"), ("a/One.md", "t2", "metadata"), ("a/One.md", "x", "inline")]


def test_links(spark):
    raw = "[[A]] ![[B#h|al]] [[vault:C]] [[ D #x]] [[Two words: E]] [[bad"
    rows = wikilinks(notes_of(spark, {"n.md": raw}), "raw").orderBy("ord").collect()
    assert [(r["target"], r["link_path"], r["subpath"], r["alias"], r["link_vault"], r["is_embed"]) for r in rows] == [
        ("A", "A", None, None, None, False), ("B#h", "B", "h", "al", None, True), ("C", "C", None, None, "vault", False), ("D #x", "D ", "x", None, None, False), ("Two words: E", "Two words: E", None, None, None, False)]
    places = link_places(notes_of(spark, {"n.md": "x [[A]] y [[A]]\n\n![[B]]"}), "raw").orderBy("line_no", "col").collect()
    assert [(r["line_no"], r["col"], r["index_on_line"]) for r in places] == [(1, 3, 0), (1, 11, 1), (3, 1, 0)]


@pytest.mark.parametrize(
    "uri, codes",
    [
        (f"{SCHEME}://open?vault=a&file=b%2Fc", set()),
        (f"{SCHEME}://open?vault=a&file=b%2Fc.md", {"markdown_extension_present", "noncanonical_uri"}),
        (f"{SCHEME}://open?vault=a&file=b%zz", {"malformed_percent_encoding", "missing_file"}),
        (f"{SCHEME}://open?vault=a&vault=b&file=c", {"duplicate_query_param"}),
        (f"{SCHEME}://open?file=c", {"missing_vault"}),
        (f"{SCHEME}://open?vault=a&file=c%23", {"invalid_subpath"}),
        (f"{SCHEME}://open?vault=a&file=c&path=x", {"path_override"}),
        (f"{SCHEME}://open?vault=a&file=c&q=1", {"unknown_query_param"}),
        (f"{SCHEME}://open/a/b", {"unsupported_shorthand", "missing_query", "missing_vault", "missing_file"}),
        (f"{SCHEME}://open?vault=a&file=c#h", {"fragment"}),
        (f"{SCHEME}://open?vault=a&file=..%2Fc", {"invalid_path"}),
        (f"{SCHEME}://open?vault=a&file=c.png", {"non_markdown_target"}),
        ("http://x", {"malformed_uri"}),
    ],
)
def test_uris(spark, uri, codes):
    row = parse(spark.createDataFrame([(uri,)], "uri string")).first()
    assert set(row["codes"]) == codes and (row["parser_status"] is None) == (not codes or codes <= {"markdown_extension_present", "noncanonical_uri"})


def test_uris_in_text(spark):
    raw = f"[x]({SCHEME}://open?vault=a&file=b) ![i]({SCHEME}://open?vault=a&file=i)\n`[c]({SCHEME}://open?vault=a&file=c)`\n```\n[d]({SCHEME}://open?vault=a&file=d)\n```\n[e]({SCHEME}://open?vault=a&file=e)"
    assert [r["uri"][-1] for r in note_uris(notes_of(spark, {"n.md": raw})).orderBy("ord").collect()] == ["b", "e"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab# \né😀-"), max_size=400), st.integers(16, 64))
def test_chunks_lose_nothing(text, budget):
    rows = chunks.chunk(text, budget)
    assert "".join(r[2] for r in rows) == text and all(len(r[1].encode()) <= budget for r in rows)
    assert len({r[0] for r in rows}) == len(rows)


def test_many_headings():
    rows = chunks.chunk("# H\nx\n" * 2000, 96)
    assert len(rows) == 2000 and rows[-1][5] == 3999
    assert "".join(r[2] for r in chunks.chunk("😀" * 1000, 95)) == "😀" * 1000


def plain_places(text):
    """(line, col, at, uri) of links outside code, by a plain walk; columns and places in UTF-16 units."""
    import re

    wide = lambda s: len(s.encode("utf-16-le")) // 2
    mask, at, fence = [False] * len(text), 0, None
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        body = line.rstrip("\n")
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", body, re.S)
        hide = []
        if fence:
            hide = [(0, len(line))]
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif m:
            fence, hide = m[1], [(0, len(line))]
        else:
            i = 0
            while i < len(body):
                if body[i] != "`" or (i and body[i - 1] == "\\"):
                    i += 1
                    continue
                run = re.match("`+", body[i:])[0]
                ends = [k.start() for k in re.finditer(r"(?<!`)" + run + "(?!`)", body) if k.start() >= i + len(run)]
                if ends:
                    hide.append((i, ends[0] + len(run)))
                i = ends[0] + len(run) if ends else i + len(run)
        for a, b in hide:
            mask[at + a : at + b] = [True] * (b - a)
        at += len(line)
    out = []
    for m in re.finditer(rf"(!?)\[[^\]\n]*\]\(<?({SCHEME}://[^\s)>]+)>?\)", text):
        if not m[1] and not mask[m.start()]:
            before = text[: m.start()]
            out.append((before.count("\n") + 1, wide(before.rsplit("\n", 1)[-1]) + 1, wide(before), m[2]))
    return out


def test_uri_places_of_any_text(spark):
    import random

    from kgspark.functions.uris import uri_places

    rng = random.Random(7)
    bits = ["`", "``", "```", "~~~", "~~~~", "\n", "\n", "\n```\n", "\n~~~ x\n", " ", "a", "🙂é", "\\`", "!", f"[l]({SCHEME}://open?vault=v&file=f)", f"[`c`](<{SCHEME}://x>)", "    ", "``` z"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    found = uri_places(spark.createDataFrame(list(enumerate(texts)), "path long, raw string").repartition(4), "raw", ("path",))
    got = {}
    for r in found.collect():
        got.setdefault(r["path"], []).append((r["line"], r["col"], r["at"], r["uri"]))
    bad = [(t, sorted(got.get(k, [])), plain_places(t)) for k, t in enumerate(texts) if sorted(got.get(k, [])) != plain_places(t)]
    assert not bad, bad[:3]
    assert sum(map(len, got.values())) > 300


def test_hints_for_all_targets_at_once(spark):
    """The same as comparing each target with every name."""
    import random

    from kgspark.operators.links import closest, closest_all

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcD") for _ in range(rng.randrange(1, 11)))
    names, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(25)} | {"", "abcDabcDabcDabcDabcD"})
    have = spark.createDataFrame([("v", n) for n in names] + [("w", "abc")], "vault string, name string")
    got = {}
    for r in closest_all(have, spark.createDataFrame([("v", a) for a in asked] + [("x", "abc")], "vault string, wanted string")).collect():
        got.setdefault(r["wanted"], []).append((r["distance"], r["name"]))
    own = have.where("vault = 'v'").select("name").cache()
    for a in asked:
        want = [(r["distance"], r["name"]) for r in closest(own, a).collect()] if a else []
        assert sorted(got.get(a, [])) == sorted(want), a


def test_hints_among_names_that_share_a_half(spark):
    """Numbered names all share a half: hints are exact, and no step makes a row for every two of them."""
    import random

    from kgspark.operators.links import closest_all, near_names

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    names = [f"Customer_{i:05d}" for i in range(3000)] + [f"{i:03d}_supplier" for i in range(0, 999, 7)]
    wanted = [f"Customer{i:05d}x" for i in range(3000)] + [f"customer_{i}x" for i in range(100, 900, 9)]
    rows = lambda texts, column: spark.createDataFrame([("v", t) for t in texts], f"vault string, {column} string")
    got = {}
    for r in closest_all(rows(names, "name"), rows(wanted, "wanted")).collect():
        got.setdefault(r["wanted"], []).append((r["distance"], r["name"]))
    for w in random.Random(2).sample(wanted, 12):
        pairs = ((edits(n.lower(), w.lower()), n) for n in names)
        assert sorted(got.get(w, [])) == sorted(p for p in pairs if p[0] <= 3)[:3], w
    low = rows(names, "name").selectExpr("vault", "name", "lower(name) AS low")
    assert near_names(low, rows([w.lower() for w in wanted], "y"), 3, 3).count() < len(names) * len(wanted) // 20
