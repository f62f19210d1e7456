"""Jaccard join, periodic runs and the Merkle manifest against brute force, on odd rows and on made groups."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from test_training_operators import SCHEMA, WORDS, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 11 jaccard join
def brute_components(rows, percent=80, size=5):
    """(doc_id, n, component id) of (doc_id, text), all pairs of different sets compared."""
    sets = []
    for _, t in rows:
        w = WORDS.findall(small(t))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    different = [s for s in dict.fromkeys(sets) if s]
    group = dict(zip(different, range(len(different))))
    for a in range(len(different)):
        for b in range(a):
            x, y = different[a], different[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                old, new = group[x], group[y]
                group = {s: new if g == old else g for s, g in group.items()}
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[group[s]] = min(least.get(group[s], i), i)
    return sorted(((i, len(s), least.get(group[s]) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_join_of_odd_rows(docs, empty):
    from kgspark.llm.jaccard_join import similar_documents

    assert joined(similar_documents(docs)) == brute_components([(r[0], r[1]) for r in odd_rows()])
    assert similar_documents(empty).collect() == []
    with pytest.raises(ValueError):
        similar_documents(docs, percent=0)


@pytest.mark.parametrize(("percent", "size", "seed"), [(80, 5, 1), (60, 2, 2), (50, 1, 3), (100, 3, 4)])
def test_join_of_groups(spark, percent, size, seed):
    """Chains of edits, a common passage, groups by the hundred: stars, their members and the rest all take part."""
    from kgspark.llm.jaccard_join import similar_documents

    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    passage, texts = [word() for _ in range(30)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(8, 80))]
        for _ in range(rng.choice([1, 3, 25])):
            texts.append(list(base))
            near = list(base)
            for _ in range(rng.randrange(6)):
                near[rng.randrange(len(near))] = word()
            texts.append(near[: rng.randrange(len(near) * 4 // 5, len(near) + 1)] + [word() for _ in range(rng.randrange(4))])
            if rng.random() < 0.5:
                base = near  # the group drifts: its ends don't link
    texts += [[word() for _ in range(rng.randrange(40))] + passage for _ in range(60)]
    rows = [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent, size)
    assert joined(got) == brute_components(rows, percent, size)


def test_stars_try_few_members_first(spark, monkeypatch):
    """Texts just out of reach of a large star's centre meet a few members first, and all of them only if that is needed."""
    from kgspark.llm import jaccard_join

    rng = random.Random(21)
    base, rows, staged = [f"w{k}" for k in range(150)], [], []

    def edited(k):
        words = list(base)
        for i in rng.sample(range(len(words)), k):
            words[i] = f"e{rng.randrange(10**9)}"
        return " ".join(words)

    rows = list(enumerate([edited(rng.choice([1, 2, 3])) for _ in range(150)] + [edited(rng.choice([3, 4, 5, 6])) for _ in range(60)]))
    kept = jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: staged.append((name, kept(df, name))) or staged[-1][1])
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert joined(got) == brute_components(rows)
    compared = [df.count() for name, df in staged if name == "join-halves"]
    assert 0 < sum(compared) <= 1500  # 3591 when every member met the centres at once


def test_join_at_the_limit_and_long_texts(spark):
    from kgspark.llm.jaccard_join import similar_documents

    nine = [f"a{k}" for k in range(13)]  # 9 shingles of 5; with a word more 10, so 9 of 10 and 8 of 10
    long = [f"b{k % 40_000}" for k in range(60_000)]
    rows = [(1, " ".join(nine)), (2, " ".join([*nine, "x"])), (3, " ".join(["y", *nine[:12]])), (4, " ".join(nine[4:])), (5, " ".join(long)), (6, " ".join([*long, "z"])), (7, "a b"), (8, "A  b"), (9, "a")]
    assert joined(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows)


def test_prefixes_share_what_they_must():
    """Whatever folds two documents chose, prefixes of a linked pair share the number that the join asks for."""
    rng = random.Random(8)
    for _ in range(3000):
        a, percent = set(rng.sample(range(60), rng.randrange(1, 30))), rng.choice([50, 80, 90])
        b = (a - set(rng.sample(sorted(a), rng.randrange(len(a) // 3 + 1)))) | set(rng.sample(range(60), rng.randrange(3)))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        least = [-(-percent * len(s) // 100) for s in (a, b)]
        rest = [m - rng.randrange(1, m + 1) for m in least]
        ends = [set(sorted(s)[: len(s) - r]) for s, r in zip((a, b), rest)]
        assert len(ends[0] & ends[1]) >= max(1, -(-percent * (len(a) + len(b)) // (100 + percent)) - max(rest))


def test_folds_grow_with_cost():
    from kgspark.llm.jaccard_join import fold_of

    assert fold_of(np.ones(100), 100, 80) == 1
    assert fold_of(np.full(100, 500.0), 100, 80) > 1
    assert fold_of(np.array([9.0]), 1, 1) == 1


# 12 periodic runs
def brute_runs(t):
    """All runs (start, length, period) of a list, each period tried at every place."""
    out = set()
    for q in range(1, len(t) // 4 + 1):
        k = 0
        while k + q < len(t):
            j = k
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            length = j - k + q
            if j > k and length >= max(6, 4 * q):
                part = t[k : k + length]
                if all(any(part[i] != part[i + p] for i in range(length - p)) for p in range(1, q)):
                    out.add((k, length, q))
            k = max(j, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, repeat):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if repeat and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made_texts(rng, many):
    texts = []
    for _ in range(many):
        t = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            p, s = rng.randrange(1, 80), rng.randrange(max(1, len(t)))
            for k in range(s + p, min(len(t), s + p * rng.randrange(2, 9) + rng.randrange(p))):
                t[k] = t[k - p]
        texts.append(t)
    return texts


def test_find_runs():
    from kgspark.llm.runs import find_runs

    rng = random.Random(3)
    for _ in range(25):
        texts = made_texts(rng, rng.randrange(1, 6))
        got = find_runs([np.array([ord(c) for c in t], dtype=np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t) for t in texts]
    assert find_runs([]) == []


def test_extensions():
    """Any two places' common length, with and without long repeats."""
    from kgspark.llm.runs import COVER, STEP, V, Extensions, agree

    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V)) and STEP.max() < V
    rng = np.random.default_rng(2)
    for letters, copies in ((1, 1), (2, 1), (50, 8), (3, 30)):
        part = rng.integers(0, letters, 200)
        x = np.concatenate([[-1], np.tile(part, copies), [-2], part, [-3]])
        i, j = rng.integers(0, len(x), (2, 4000))
        i, j = i[i != j], j[i != j]
        assert (Extensions(x, len(x))(i, j) == agree(x, i, j, len(x) - np.maximum(i, j))).all()


def test_runs_of_documents(spark, docs, empty):
    from kgspark.llm.runs import periodic_runs

    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in odd_rows()]
    more = [(k, " ".join(t) + rng.choice(["", "\n", " \t"])) for k, t in enumerate(made_texts(rng, 120))]
    for have, df in ((rows, docs), (more, spark.createDataFrame(more, "doc_id long, text string"))):
        for repeat in (False, True):
            got = sorted((tuple(r) for r in periodic_runs(df, repeat).collect()), key=str)
            assert got == sorted((brute_row(i, t, repeat) for i, t in have), key=str)
    assert periodic_runs(empty).collect() == []


def test_runs_of_a_long_text(spark):
    from kgspark.llm.runs import periodic_runs

    words = [str(k) for k in range(50_000)] + [f"p{k % 9_001}" for k in range(40_000)] + ["end"]
    r = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 50_000, 40_000, 9_001, 4443)
    assert r["collapsed_sha256"] == hashlib.sha256(" ".join(words[:59_001] + ["end"]).encode()).hexdigest()


# 13 merkle manifest
def sha_of(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return sha_of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha_of(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run, k = level[i // 3 * 3 :][:3], i % 3
        out.append((run[:k], run[k + 1 :]))
        i //= 3
    return out


def brute_manifest(rows):
    sources, out = {}, []
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    trees = [tree_of([leaf_of(r, r[1]) for r in sources[s]]) for s in order]
    top = tree_of([t[-1][0] for t in trees]) if trees else None
    for p, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            path = path_of(trees[p], i) + path_of(top, p)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf_of(r, r[1].replace("\n", "") if hit else r[1])
            for left, right in path:
                now = sha_of(*left, now, *right)
            root = top[-1][0]
            out.append((r[0], trees[p][0][i], trees[p][-1][0], root, sha_of(*[d for a, b in path for d in a + b]), now, now == root))
    return sorted(out, key=str)


def manifested(df):
    from kgspark.llm.merkle import manifest

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in manifest(df).select(*names).collect()), key=str)


def test_manifest_of_odd_rows(docs, empty):
    assert manifested(docs) == brute_manifest(odd_rows())
    assert manifested(empty) == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {"a": 4}, {None: 1, "b": 1}, {None: 9, "ä": 1, "z": 2, "a": 82}, {"hot": 260, "x": 27, "y": 28, **{f"s{k}": 1 for k in range(11)}}])
def test_manifest_of_shapes(spark, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 7
            rows.append((k, f"line {k}\nof {s}" * (k % 3), "en", s, k))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert manifested(df) == brute_manifest(rows)


def test_manifest_of_equal_rows_and_a_long_text(spark):
    rows = [(1, "same\ntext", "en", "a", 9)] * 30 + [(1, "same\ntext", "en", "b", 9)] * 3 + [(2, "long\n" * 400_000, None, "c", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifested(df) == brute_manifest(rows)


def test_manifest_sql(spark, data_dir):
    from kgspark.llm import merkle

    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{data_dir}/documents.parquet')")
    want = db.execute(merkle.SQL)
    names = [c[0] for c in want.description]
    got = merkle.op13_merkle_manifest(spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# 9 packing: what is alike is spread
def test_pieces_without_ids_use_all_salts(spark):
    from kgspark.llm.packing import pack_pieces

    same = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "CAST(0 AS long) AS start", "100 AS length", "CAST(7 AS long) AS ids_crc32")
    placed = pack_pieces(same, 2048)
    assert placed.count() == 3000 and placed.select("sequence_id", "offset").distinct().count() == 3000 and placed.agg({"sequence_id": "max"}).first()[0] == 149
    plan = placed._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(29, _row" in plan and "xxhash64(29, doc_id" not in plan
