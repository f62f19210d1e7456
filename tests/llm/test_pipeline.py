"""The pipeline against its parts: what each stage must keep, found by other means."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, data_dir):
    import corpus_pipeline as cp

    from kgspark.llm.common import stage

    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in cp.STAGES:
        docs = stage(f(spark, docs, data_dir), f"test-{name.replace('_', '-')}")
        out[name] = docs
    return out


def test_columns_and_subsets(stages):
    names = list(stages)
    for a, b in zip(names[:4], names[1:5]):
        assert stages[a].columns == stages[b].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stages[b].join(stages[a], ["doc_id", "text"], "left_anti").count() == 0
    assert 0 < stages["simhash_dedup"].count() <= stages["language_id"].count() <= stages["quality_rules"].count() < stages["documents"].count()


def test_clean_documents_stay(stages, spark, data_dir):
    good = spark.read.parquet(f"{data_dir}/labels.parquet").where("quality = 1").join(stages["documents"], "doc_id").where("n_chars > 400")
    assert good.join(stages["quality_rules"], "doc_id", "left_semi").count() >= 0.95 * good.count()
    assert stages["language_id"].count() >= 0.95 * stages["quality_rules"].count()


def brute_groups(texts, size=5, similarity=0.8):
    """Group number of each text: connected by pairs whose shingle sets are similar enough, all pairs compared."""
    from test_training_operators import WORDS

    def shingles(t):
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
    return group


def test_one_of_each_group(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages["language_id"].collect())
    group = brute_groups([t for _, t in rows])
    want = {min(i for (i, _), x in zip(rows, group) if x == g) for g in set(group)}
    assert {r["doc_id"] for r in stages["simhash_dedup"].select("doc_id").collect()} == want


def test_dedup_finds_all_similar_texts(spark):
    """Near copies at similarities around 0.8, a large group of copies of one text, chains of edits, and texts that share half."""
    import random

    from kgspark.llm.near_texts import similar_texts

    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return w

    texts, base, shared = [], words(120), words(60)
    texts += [edited(base, rng.randrange(0, 6)) for _ in range(160)]  # one large group, copies unlike each other
    for _ in range(40):
        own = words(rng.randrange(4, 200))
        texts += [own] + [edited(own, k) for k in range(rng.randrange(5))]
    chain = words(90)
    for _ in range(12):
        chain = edited(chain, 1)
        texts.append(chain)
    texts += [shared + words(60) for _ in range(40)] + [[], [], ["one"], ["One"], ["one", "two"]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    hashes = docs.select("text", F.xxhash64(F.lit(31), "text").alias("text_hash")).distinct()
    rows, roots = similar_texts(docs)
    group, got, want = brute_groups(texts), {}, {}
    named = rows.join(hashes, "text_hash").join(roots, "node", "left").select("text", F.coalesce("root", "node").alias("root"))
    for r in named.collect():
        got.setdefault(r["root"], set()).add(r["text"])
    for t, g in zip(texts, group):
        want.setdefault(g, set()).add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_majority():
    """Fingerprints of shingle sets: bits that over half of the hashes have."""
    from kgspark.llm.shingling import majority

    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 7, 0, 30]
    h, start = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64), np.cumsum([0, *sizes])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[lo:hi]) > hi - lo) for lo, hi in zip(start[:-1], start[1:])]
    assert [int(x) for x in majority(h, start)] == want


def test_blocks_bound_memory():
    """What a worker holds for a block of text: arrays of languages and shingles stay under 48 MB (98 and 64 before)."""
    import tracemalloc

    from kgspark.llm import jaccard_join, langid
    from kgspark.llm.shingling import majority, shingles

    text = "the cat and the dog went to the house of her mother on a rainy morning in may "
    texts = lambda size: [f"{i} {text * 25}" for i in range(size // (25 * len(text)))]
    model = langid.fit([text * 20, "der hund und die katze " * 20], ["en", "de"])
    for work, size in (
        (lambda x: langid.identify(model, x), getattr(langid, "BLOCK", 3 << 20)),
        (lambda x: majority(*shingles([t.encode() for t in x], 5)), jaccard_join.BLOCK),
    ):
        x = texts(size)
        tracemalloc.start()
        work(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20, peak >> 20


def test_mix_and_pack(stages):
    from test_training_operators import WORDS, brute_targets

    size = {r["doc_id"]: (r["source"], len(WORDS.findall(r["text"]))) for r in stages["simhash_dedup"].collect()}
    sizes, taken = {}, {}
    for s, n in size.values():
        sizes[s] = sizes.get(s, 0) + n
    copies = {r["doc_id"]: r["n"] for r in stages["mixing"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(copies.values()) <= 2
    for i, n in copies.items():
        taken[size[i][0]] = taken.get(size[i][0], 0) + n * size[i][1]
    total, target = sum(taken.values()), brute_targets(sizes)
    assert total == pytest.approx(sum(target.values()), rel=0.25)  # whole documents of a small table
    packed = stages["packing"].toPandas()
    assert set(packed.doc_id) == set(copies)
    ends = packed.assign(end=packed.offset + packed.length).groupby("sequence_id").agg(n=("length", "sum"), end=("end", "max"))
    assert (ends.n == ends.end).all() and (ends.n <= 2048).all()
    assert len(ends) <= np.ceil(packed.length.sum() / 2048) + 3


def test_run_gives_rows(spark, data_dir):
    import corpus_pipeline as cp

    assert cp.run(spark, data_dir).count() > 0 and cp.ORACLE_SQL is None


def test_odd_rows_pass_through(spark, data_dir):
    """Null ids, repeated ids and clashing columns go through every stage that has no reason to stop them."""
    import corpus_pipeline as cp

    from kgspark.llm.mixing import mix_stage

    text = lambda k: " ".join(f"the{k}x{i}" for i in range(40))
    rows = [(1, text(1), "s"), (1, text(1), "s"), (2, text(1), "s"), (None, text(3), None), (4, None, "t"), (5, text(5), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    docs = docs.withColumns({c: F.lit(c) for c in ("copies", "size", "kept", "score", "lang_pred", "n_words", "fp", "component_id", "shard", "length", "piece")})
    count, stages = {}, dict(cp.STAGES)
    for name in ("quality_rules", "language_id", "simhash_dedup", "mixing"):
        out = stages[name](spark, docs, data_dir)
        assert out.columns == docs.columns
        count[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert count["simhash_dedup"] == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert count["language_id"] == [(False, 1), (False, 1), (False, 2), (False, 5), (True, 0)]
    assert stages["packing"](spark, docs, data_dir).count() == len(rows)
    mixed = mix_stage(spark, docs.where("doc_id is null or doc_id in (4, 5)"), "")
    assert mixed.where("doc_id is null").count() > 0 and mixed.where("text is not null").count() >= 2
    for name, f in cp.STAGES:
        assert f(spark, docs.limit(0), data_dir).count() == 0


def test_dedup_keeps_texts_under_shared_ids(spark):
    """Different texts under null and repeated ids stay; one row of each group does."""
    from kgspark.llm.near_texts import dedup_stage

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (None, text(0))]
    rows += [(7, text(10)), (7, text(11)), (7, text(10)), (3, text(10)), (9, text(4)), (8, text(12)), (8, text(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in dedup_stage(spark, docs, "").collect()))
    want = [(True, 0, text(k)) for k in range(4)] + [(False, 9, text(4)), (False, 3, text(10)), (False, 7, text(11)), (False, 8, text(12))]
    assert got == sorted(want)


def near_copies():
    """Rows in groups of near copies and of exact ones, and rows on their own."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for k in range(5 if g % 2 else 1):
            own = list(words)
            own[int(rng.integers(60))] = f"x{k}" if k else own[0]
            rows.append((len(rows), " ".join(own)))
    return rows


def test_dedup_leaves_one_table(spark, monkeypatch, tmp_path):
    """Of all tables that the stage writes on its way, only the one that its result reads is left (all were left before)."""
    from kgspark.llm import common, near_texts

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = near_copies()
    out = near_texts.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["near-keep"]
    group = brute_groups([t for _, t in rows])
    assert {r["doc_id"] for r in out.collect()} == {group.index(g) for g in set(group)}


def test_staged_write_frees_shuffle_files(spark):
    """The shuffle files of a staged table go with its write, not when the driver collects garbage; the setting is as it was."""
    import time
    from pathlib import Path

    from kgspark.llm import common

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in blocks.localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}
    before, set_to = files(), spark.conf.get(common.FREED, None)
    out = common.stage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "test-freed")
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(common.FREED, None) == set_to
    assert out.count() == 10


def test_leaders_in_few_shuffles(spark):
    """Leaders are chosen in three shuffles of lists and pairs; sizes come with the lists (they were joined twice before)."""
    from kgspark.llm.jaccard_join import chosen

    shared = spark.createDataFrame([(t, n, 10, 2) for t in range(20) for n in range(4)] + [(99, 9, 100, 2), (99, 1, 10, 2)], "token long, node long, n int, rest int")
    with_conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        got = chosen(shared, shared, 0, 80)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 4, plan
        rows = {r["a"]: r["b"] for r in got.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 3 and len(set(rows.values())) == 1 and 9 not in rows
