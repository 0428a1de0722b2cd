"""The llm operators against brute force, on planted cases and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, chat, decontam, embeddings, ftrl, line_dedup, minhash, packing, quality, runtime, secrets, sharding, toxicity
from tessera.llm.components import components, forest
from tessera.llm.runtime import fresh_path

DOCS = "doc_id long, text string"
ODD = [(None, "null id words here"), (901, None), (902, ""), (903, "   \n\n "), (904, "one"), (905, "é ß 漢字 🙂"), (906, "x" * 20000), (907, "same row"), (907, "same row")]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    # columns whose names clash with inner ones
    return df.select("*", F.lit(1).alias("n"), F.lit("z").alias("_id"), F.lit(0.5).alias("score"), F.lit(7).alias("n_removed")) if extra else df


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---- components


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    found, _ = components(df)
    expected = roots(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    got = {r["node"]: r["component"] for r in found.collect()}
    assert all(got.get(n, n) == c for n, c in expected.items())
    assert components(df.limit(0))[0].count() == 0


def test_a_node_of_many_links_is_dealt_to_many_tasks(spark):
    edges = spark.range(100_000).select(F.lit(5).cast("long").alias("a"), (F.col("id") + 10).alias("b"))
    found, _ = components(edges.unionAll(spark.createDataFrame([(100_005, 200_000), (200_000, 300_000)], "a long, b long")))
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(5, 100_002)]
    many, one = edges.withColumnRenamed("a", "k"), spark.createDataFrame([(5, "x"), (6, "y")], "k long, v string")
    counts = many.groupBy("k").agg(F.count("*").alias("n_rows"))
    joined = runtime.join_dealt(many, one, ["k"], counts, 100_000)
    assert joined.columns == ["k", "b", "v"] and joined.count() == 100_000
    assert joined.filter("v <> 'x' or v is null").isEmpty()


def test_forest_spans_links():
    rng = np.random.default_rng(3)
    linked = rng.random((20, 15)) < 0.08
    tree = forest(linked)
    all_links = [(i, 100 + j) for i, j in zip(*np.nonzero(linked))]
    nodes = {x for p in all_links for x in p}
    assert roots(all_links, nodes) == roots([(i, 100 + j) for i, j in tree], nodes) and len(tree) < len(nodes)


# ---- 1 decontamination


def edit_distance_inside(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_matcher_finds_what_brute_force_finds():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    hits = 0
    for _ in range(60):
        items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(3)]
        m = decontam.Matcher(items, 0.1, 2, 20)
        text = list(" ".join(rng.choice(words) for _ in range(30)) + " " + rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        text = decontam.normalise("".join(text))
        got = {n: d for n, d, _, _ in m.matches(text)}
        for n, (_, item, k) in enumerate(m.items):
            d = edit_distance_inside(item, text)
            assert got.get(n) == (d if d <= k else None)
            hits += d <= k
    assert hits > 20


def test_leaks_planted_and_odd(spark):
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))
    near = item.replace(item[30:36], "ZZZZZZ", 1).upper().replace(" ", ",  ")
    rows = [(1, "before " + item + " after"), (2, "x, " + near + "!"), (3, sentence(rng, 50)), (4, item[: len(item) // 2]), *ODD]
    items = spark.createDataFrame([(10, item), (11, None), (12, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 10), (2, 10)} and got[1, 10]["distance"] == 0 and got[2, 10]["distance"] > 0
    r = got[1, 10]
    assert rows[0][1][r["start"] : r["end"]] == item
    left = decontam.without_leaks(docs_of(spark, rows), items)
    assert left.count() == len(rows) - 2 and left.columns == docs_of(spark, rows).columns
    assert decontam.find_leaks(docs_of(spark, rows), items.limit(0)).count() == 0
    assert decontam.find_leaks(docs_of(spark, rows).limit(0), items).count() == 0
    in_blocks = decontam.find_leaks(docs_of(spark, rows), items.union(items), block_chars=10)
    assert in_blocks.count() == 4


def test_short_items_leak_word_for_word(spark):
    short = "Who wrote the play about the Danish prince?"[:39].rstrip()
    assert len(decontam.normalise(short)) < 40
    rows = [
        (1, f"Question: {short}  Answer: a poet"), (2, short.upper().replace(" ", "\n")), (3, f"x{short}"), (4, f"{short}s of old"), (5, short.replace("wrote", "wrate")),
        (6, "pick 42, then go"), (7, "pick 142 or 421"), (8, "他问：中国的首都是哪里？北京"), (9, "a 42"), *ODD,
    ]
    items = spark.createDataFrame([(10, short), (11, "42"), (12, "中国的首都是哪里"), (13, "?!"), (14, ""), (15, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 11), (9, 11), (8, 12)}
    assert all((r["distance"], r["budget"]) == (0, 0) for r in got.values())
    assert rows[0][1][got[1, 10]["start"] : got[1, 10]["end"]] == short and rows[7][1][got[8, 12]["start"] : got[8, 12]["end"]] == "中国的首都是哪里"
    left = [r["doc_id"] for r in decontam.without_leaks(docs_of(spark, rows), items).collect()]
    assert Counter(left) == Counter([3, 4, 5, 7, *(i for i, _ in ODD)])


# ---- 2 embeddings


@pytest.mark.parametrize("params", [embeddings.Params(), embeddings.Params(cell_rows=40, block_rows=16)])
def test_vectors_match_brute_force(spark, params):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    x = [list(map(float, centres[i % 30] + rng.normal(scale=0.15, size=8))) for i in range(300)]
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + [(1000 + i, x[0], 0) for i in range(5)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [float("nan")] * 8, 1), (2004, x[1], None), (None, x[2], 2), (2005, [1.0, 2.0], 1), (2006, [None] + x[0][1:], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.link_vectors(df, params).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows[:305]]
    pairs = [(a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :] if a[2] == b[2] and a[1] @ b[1] >= 0.93]
    number = Counter(x for p in pairs for x in p)
    root = roots(pairs, [g[0] for g in good])
    assert len(got) == len(rows)
    for i, _, _ in good:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (number[i], root[i], root[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006, None))
    assert embeddings.link_vectors(df.limit(0), params).count() == 0


def test_vectors_of_repeated_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    df = df.filter("vec_id < 3")
    assert sorted((r["vec_id"], r["n_links"]) for r in embeddings.link_vectors(df).collect()) == [(1, 0), (1, 1), (2, 1)]


# ---- 3 lines


def lines_by_hand(rows):
    places = {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    gone = {r: set() for r in order}
    for r in order:
        ls = r[1].split("\n")
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in places:
                gone[r] |= {k, k + 1, k + 2}
            else:
                places[w] = r
    return {r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r]) for r in order}


def test_lines_match_a_plain_run(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(500, "a\na\na\na\na"), *ODD]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    expected = lines_by_hand(rows)
    assert len(out) == len(rows)
    by_row = Counter((r["doc_id"], r["text"]) for r in out)
    assert by_row == Counter((i, None if t is None else expected[i, t]) for i, t in rows)
    assert sum(r["n_removed"] for r in out) > 100
    kept = {x for r in out if r["text"] for x in r["text"].split("\n")}
    assert {x for _, t in rows if t for x in t.split("\n")} - {"", " ", "   "} <= kept  # no line vanishes
    assert line_dedup.dedup_lines(docs_of(spark, []).limit(0)).count() == 0


# ---- 4 shards


def test_compaction_keeps_rows_and_versions(spark):
    store = sharding.ShardStore(spark, fresh_path(spark, "test-store"), target_bytes=40_000, fanout=3)
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60)) for i in range(600)] + ODD
    df = docs_of(spark, rows).withColumn("shard", F.lit("own"))
    store.append(df.filter("doc_id < 300"), shard_rows=20)
    store.append(df.filter("doc_id >= 300 or doc_id is null"), shard_rows=20)
    before = store.shards()
    version = store.compact()
    after = store.shards(version)
    assert version == 3 and len(after) < len(before) / 2 and sum(s.rows for s in after) == len(rows)
    got = store.read()
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows)
    assert {r["shard"] for r in got.select("shard").distinct().collect()} == set(range(len(after)))
    assert max(s.bytes for s in after) <= 2 * 40_000
    with pytest.raises(Exception):  # the number is taken
        store.commit(version - 1, after, df.schema)
    assert store.version() == version
    own = store.read(number="_place")  # a column of this name is the user's own
    assert {r["shard"] for r in own.select("shard").distinct().collect()} == {"own"} and "_place" in own.columns
    old = store.read(version - 1)  # an older version is still there
    assert Counter((r["doc_id"], r["text"]) for r in old.collect()) == Counter(rows) and store.shards(version - 1) == before

    def files():
        return {str(f.relative_to(f"{store.root}/data")) for f in Path(f"{store.root}/data").rglob("*.parquet")}

    held = files()
    with pytest.raises(Exception):  # a commit that fails leaves nothing behind
        stale = sharding.ShardStore(spark, store.root)
        stale.version = lambda: version - 1
        stale.append(df.limit(3))
    assert files() == held
    assert store.expire(version) == len(before) - len([s for s in after if s in before]) and store.read().count() == len(rows)
    assert {s.name for s in after} <= files() and len(files()) <= len(after) + 1 and store.expire(version) == 0
    empty = sharding.ShardStore(spark, fresh_path(spark, "test-store"))
    assert empty.append(df.limit(0)) == 1 and empty.shards() == [] and empty.compact() == 1
    nothing = empty.read()
    assert nothing.count() == 0 and nothing.columns == store.read().columns and nothing.select("doc_id", "text").schema == store.read().select("doc_id", "text").schema


def test_plans_end_and_respect_the_target():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.choice([10, 1000, 70_000, 300_000, 2_000_000]) for _ in range(rng.randint(0, 60))]
        groups = sharding.plan_merges(sizes, 1_000_000, 4)
        used = [i for g in groups for i in g]
        assert len(used) == len(set(used)) and all(len(g) > 1 and sum(sizes[i] for i in g) <= 1_000_000 for g in groups)


# ---- 5, 6 classifiers


def test_quality_learns_signs_and_handles_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 40) if i % 2 else " ".join(f"w{rng.randrange(400)}{rng.choice(['###', '$$$'])}" for _ in range(40))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 1), (301, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    held = quality.fold(5) == 0
    out = {r["doc_id"]: r for r in quality.decided(quality.score_quality(docs_of(spark, rows + ODD), labels, ~held), held).collect()}
    right = [out[i]["predicted"] == i % 2 for i in range(300, 400)]
    assert sum(right) >= 97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[901]["score"] == out[902]["score"]
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert {r["score"] for r in quality.score_quality(docs_of(spark, ODD), labels.limit(0), ~held).collect()} == {0.5}
    assert quality.score_quality(docs_of(spark, ODD).limit(0), labels, ~held).count() == 0


def test_toxicity_restores_disguised_words(spark):
    rng = random.Random(9)
    bad = ["idiot", "scumbag", "worthless"]
    rows = [(i, sentence(rng, 30, 60) + (" " + rng.choice(bad) if i % 4 == 0 else "") + " " + sentence(rng, 10, 60) + " the ratio is radio video studio idiom worth less") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    tests = [(700, "you 1d10t w5"), (701, "you i d i o t"), (702, "what a w0rthle$s thing"), (703, "an idiiiiot"), (704, "w1 w2 w3 fine words 2nd 3rd"), (705, "s.c.u.m.b.a.g"), *ODD]
    docs = docs_of(spark, rows + tests)
    every = F.lit(True)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, every).collect()}
    assert all(out[i] >= 0.3 for i in (700, 701, 702, 703, 705)), {i: out[i] for i in range(700, 706)}
    assert out[704] < 0.3 and all(out[i] < 0.3 for i in (901, 902, 903))
    assert sum((out[i] >= 0.3) == (i % 4 == 0) for i in range(600)) >= 590
    left = toxicity.drop_toxic(docs, labels, every)
    assert left.columns == docs.columns and 700 not in {r["doc_id"] for r in left.collect()}
    assert toxicity.score_toxicity(docs.limit(0), labels, every).count() == 0


def test_lattice_and_restorer():
    counts = np.zeros(28**3, dtype=np.int64)
    for word in ("idiot", "tool", "bottle"):
        s = [27, 27, *(ord(c) - 97 for c in word), 27]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * 28 + b) * 28 + c] += 100
    r = toxicity.Restorer(toxicity.language_model(counts))
    assert [r.restore(x) for x in ("1d10t", "b0ttle", "i-d-i-o-t", "t00l", "idiiiot", "é1")] == ["idiot", "bottle", "idiot", "tool", "idiot", r.restore("é1")]
    assert r.restore("") == ""


DISGUISES = {
    "moron": ["m 0 r 0 n", "m.0.r.0.n", "m  0-r_0*n", "mmoorroonn"], "idiot": ["i d 1 0 t", "1 d i o t", "idio+", "iddiioott", "iidiot", "!d!0+", "1-d-1-0-t"],
    "trash": ["t r @ s h", "+rash"], "loser": ["l 0 s 3 r", "|0ser"], "ass": ["a$$"], "thrill": ["thr!||", "t h r i l |"],
}


def test_combined_disguises_are_restored():
    counts = np.zeros(28**3, dtype=np.int64)
    for word in (*DISGUISES, "as", "worthy", "day", "hello"):
        s = [27, 27, *(ord(c) - 97 for c in word), 27]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * 28 + b) * 28 + c] += 100
    cost = toxicity.language_model(counts)
    r = toxicity.Restorer(cost)
    assert all(word in r.words(f"you {x} there") for word, forms in DISGUISES.items() for x in forms), {x: r.words(x) for forms in DISGUISES.values() for x in forms}
    assert r.words("1 2 3 and 4 5 7") == [] and r.words("hello! a day!!") == ["hello", "day"]
    featurise = toxicity.make_featurise(cost)
    for word, forms in DISGUISES.items():  # the gate before the pattern lets them through
        plain = {int(x) for f, _ in featurise(pa.array([word])) for x in f}
        for x in forms:
            assert plain & {int(y) for f, _ in featurise(pa.array([f"you {x} there"])) for y in f}, x


def test_gate_lets_all_disguises_through():
    rng = random.Random(14)
    letter, leet = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    letter[97:123] = True
    leet[[ord(c) for c in toxicity.LEET]] = True
    hits = 0
    for _ in range(3000):
        text = "".join(rng.choice("abo0$!|+  .-") for _ in range(rng.randint(5, 9)))
        if any(re.search("[a-z]", m[0]) for m in toxicity.DISGUISED.finditer(text)):
            hits += 1
            rows = toxicity.doubtful_rows(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]), letter, leet)
            assert len(rows), text
    assert hits > 500


def test_features_and_counts_do_not_depend_on_neighbours(spark):
    rng = random.Random(15)
    texts = ["a b c", "", "xx a", "@ b", "a@", "s", "p a m", "$$", "b", "ab 0", None] + ["".join(rng.choice("abo0$!|+  .-é") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    counts = [sorted(tuple(r) for r in toxicity.char_counts(docs.repartition(n)).collect()) for n in (1, 16)]
    assert counts[0] == counts[1]
    featurise = toxicity.make_featurise(toxicity.language_model(np.zeros(28**3, dtype=np.int64)))
    together = [f[at[i] : at[i + 1]].tolist() for f, at in featurise(pa.array(texts)) for i in range(len(at) - 1)]
    alone = [next(featurise(pa.array([t], pa.string())))[0].tolist() for t in texts]
    assert together == alone


def test_ftrl_gives_sparse_weights():
    rng = np.random.default_rng(1)
    docs = [np.unique(np.concatenate([rng.integers(10, 500, 20), [1] if i % 2 else [2]])) for i in range(400)]
    m = ftrl.train(docs, np.arange(400) % 2.0, 3, 0.5, 1.0, 2.0, 0.0, 3)
    w = dict(zip(m.features, m.weights))
    assert w[1] > 1 and w[2] < -1 and len(w) < 200
    assert ftrl.train([], np.zeros(0), 1, 1, 1, 1, 1, 1).scores(np.zeros(0, int), np.array([0, 0]))[0] == 0.5


# ---- 7 near copies


def sets_by_hand(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("partners", "block", "salts"), [(32, 512, 512), (-1, 3, 8)])
def test_near_copies_match_brute_force(spark, monkeypatch, partners, block, salts):
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(runtime, "SALTS", salts)
    monkeypatch.setattr(runtime, "LEAST_HOT", 100 if salts == 512 else 2)
    rng = random.Random(10)
    rows = []
    for g in range(12):
        base = sentence(rng, rng.randint(60, 120)).split(" ")
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(800 + i, rows[0][1].upper()) for i in range(4)] + [(r[0], r[1]) for r in ODD[1:-1]]
    p = minhash.Params(words=3, percent=85, half=3, m=8)
    out = minhash.near_duplicates(docs_of(spark, rows + [(907, "same row"), (None, "null id words here")]), p).collect()
    got = {r["doc_id"]: r for r in out}
    sets = sets_by_hand(rows, 3)
    ids = list(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(pairs, ids)
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert got[None]["component_id"] is None and got[None]["kept"] and len(out) == len(rows) + 2
    assert minhash.near_duplicates(docs_of(spark, ODD).limit(0), p).count() == 0


def test_one_of_each_keeps_what_stands_alone(spark):
    rng = random.Random(16)
    t, u, v = (sentence(rng, 40) for _ in range(3))
    rows = [(1, t), (1, t), (2, u), (5, t), (5, v), (None, u), (None, None), (7, ""), (7, ""), (8, t + " more"), (9, v), (9, v)]
    docs = docs_of(spark, rows).withColumn("key", F.lit("own")).withColumn("a.b", F.lit(3))
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and {(r["key"], r["a.b"]) for r in left.collect()} == {("own", 3)}
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, t), (2, u), (5, v), (None, None), (7, ""), (7, "")])
    only = docs.filter("doc_id is null or doc_id = 9")
    assert Counter((r["doc_id"], r["text"]) for r in minhash.one_of_each(only).collect()) == Counter([(None, u), (None, None), (9, v)])
    assert minhash.one_of_each(docs.limit(0)).count() == 0


# ---- 8 secrets


def spans_by_hand(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_match_python_and_link(spark):
    rng = random.Random(11)
    bits = ["token=", "PASSWORD : ", "api_key: '", "abcdefgh12", "AKIA", "ABCDEFGHIJKLMN", "é🙂", " ", "\n", "0123456789abcdef" * 2, "short", "secret", "=", "user=bob ", "http://h/p "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)] + ODD
    out = secrets.secret_digests(secrets.scan_secrets(docs_of(spark, rows))).collect()
    names = ("assign", "access", "hex")
    expected = Counter((i, hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans_by_hand(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in out) == expected
    far = "x" * 400
    rows = [(1, "user=bob"), (2, "user=bob token=short"), (3, f"user=bob {far} token=short"), (4, "bearer abcdefghijk http://a.b"), (5, "http://a.b")]
    rows.append((6, "http://a.b user=bob user=al token=short http://c.d/e"))
    out = {r["doc_id"]: (r["spans"], r["links"]) for r in secrets.secret_digests(secrets.scan_secrets(docs_of(spark, rows))).collect()}
    assert out == {
        1: ("", ""), 2: ("ident:0:8,weak:9:20", "ident:0:8>weak:9:20,weak:9:20>ident:0:8"), 3: ("", ""),
        4: ("weak:0:18,endpoint:19:29", "weak:0:18>endpoint:19:29,endpoint:19:29>weak:0:18"), 5: ("", ""),
        6: (
            "endpoint:0:10,ident:11:19,ident:20:27,weak:28:39,endpoint:40:52",
            "endpoint:0:10>weak:28:39,ident:11:19>weak:28:39,ident:20:27>weak:28:39,weak:28:39>ident:20:27,endpoint:40:52>weak:28:39",
        ),
    }


# ---- 9 packing


@pytest.mark.parametrize(("parts", "most_open", "second_ids"), [(2, 4096, 1 << 24), (7, 3, 20_000)])
def test_packing_round_trip(spark, parts, most_open, second_ids):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.choice([0, 1, 5, 90, 700, 1500]))) for i in range(150)] + ODD + [(950, "It's <|endoftext|> Ünïcode, A1b2. x!? " * 30)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(docs_of(spark, rows).repartition(parts), most_open=most_open, second_ids=second_ids)
    out = packed.collect()
    assert sorted(map(str, out)) == sorted(map(str, packed.collect()))
    assert {(r["doc_id"], r["doc_tokens"]) for r in out} == {(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows}
    for i, t in {r for r in rows if r[0] not in (None, 907)}:
        pieces = sorted((r["start"], r["length"], bytes(r["ids"])) for r in out if r["doc_id"] == i)
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        assert b"".join(p[2] for p in pieces) == ids and [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces[:-1])]))
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        total = sum(p[1] for p in parts)
        assert [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts[:-1])])) and total <= 2048 and total & (total - 1) == 0
    share = packing.strung_share(packed).first()["share"]
    assert share == sum(r["length"] for r in out if r["strung"]) / sum(r["length"] for r in out)
    digest = packing.piece_digests(packing.pack(docs_of(spark, rows))).filter("doc_id = 1").orderBy("start").collect()
    ids = np.array(tokenizer.encode(rows[1][1], add_special_tokens=False).ids + [1], dtype="<u4")
    assert [r["ids_crc32"] for r in digest] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in digest]
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, rows), seq_len=1000)


def test_words_of_one_batch_are_merged_without_the_tokenizer(monkeypatch):
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abcdefghiéüñÉ", k=rng.randint(1, 20))) + rng.choice(["", ",", ".", "&&&", "7"]) for _ in range(400)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    cache, calls = packing._worker_tokenizer(None), []
    want = sum(len(cache.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for name in ("_ids", "_word_ids"):
        monkeypatch.setattr(packing.WordCache, name, lambda self, part, real=getattr(packing.WordCache, name): calls.append(part) or real(self, part))
    rows = [r for b in packing._first_pass([batch], 2048, 1, None, 4096) for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == want and not calls


@pytest.mark.parametrize("size", [2 << 20, 40])
def test_words_merged_in_arrays_have_the_tokenizers_ids(monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    rng = random.Random(15)
    some = ["a", "b", "the", "tion", " ", " ", "\n", "'", "'s", "'re", "12", ",", ".", "&&&", "É", "é", "ß", "ÿ", "×", "÷", "\u0301", "\t", "\x1c", "\x7f", "\x00", "\x85", "日本", "Σ", "а", "😀", "_", "<", "|", "İ", "K", "\xa0", "½", "µ", "x" * 40, "!" * 33, "ab" * 16]
    texts = ["", " ", "\n", "a", "'s", "<|endoftext|> a", "aaaa" * 8, "aaaa" * 8 + "a"] + ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    other = Tokenizer.from_str(tokenizer.to_str().replace('{"type":"NFC"},', ""))  # another shape, which goes word by word
    for tok, fits in ((tokenizer, True), (other, False)):
        cache = packing.WordCache(tok)
        assert (cache.arrays is not None) == fits
        for text, ids in zip(texts, cache.encode_all([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_placement_minimises_squares():
    rng = random.Random(13)
    p = packing.SumOfSquares(64)
    for k in range(300):
        size = rng.randint(1, 63)
        before = p.counts.copy()

        def total(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return int((c[1:64] ** 2).sum())

        choices = [0] + [h for h in range(1, 64 - size + 1) if before[h] > 0]
        assert total(p.level_for(size)) == min(map(total, choices))
        list(p.add(k, bytes(4 * size)))
    for seq_len, n in ((64, 200), (64, 0), (8, 3)):
        windows = [[(k, 0, 5, bytes(4 * 5))] for k in range(n)]
        sizes = [sum(len(x[3]) // 4 for x in w) for w in packing.string_out(windows, seq_len)]
        assert sum(sizes) == 5 * n and all(x & (x - 1) == 0 for x in sizes) and sum(x < seq_len for x in sizes) <= seq_len.bit_length()


def test_open_windows_of_all_partitions_are_placed(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).cast("int")).alias("text"))
    shares = [packing.strung_share(packing.pack(docs.repartition(24), seq_len=128, second_ids=n)).first()["share"] for n in (1, 1 << 24)]
    assert shares[1] < 0.04 and shares[1] < shares[0] / 3


# ---- 10 chats


def test_chat_events_and_round_trip(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "a"), (1, 2, 1, "delta", None, "b"), (1, 3, 1, "regenerate", None, "gone"),
        (1, 4, 1, "delta", None, "c</s>[INST]\\"), (1, 5, 1, "delta", None, "d"), (1, 6, 0, "edit", None, "HI"), (None, 0, 0, "odd", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("i", F.lit(1))
    chats = chat.format_chats(events)
    turns = {(r["conv_id"], r["i"]): (r["role"], r["text"], r["loss_text"]) for r in chat.read_back(chats).collect()}
    assert turns == {(1, 0): ("user", "HI", None), (1, 1): ("assistant", "c</s>[INST]\\d", "c</s>[INST]\\d"), (None, 0): ("", "", None)}
    row = chats.filter("conv_id = 1").first()
    span = row["loss"][1]
    assert row["formatted"][span["start"] : span["end"]].count("</s>") == 0
    assert chat.chat_digests(chat.format_chats(events.limit(0))).count() == 0


def test_random_logs_match_a_plain_fold(spark):
    rng = random.Random(17)
    log, seq = [], 0
    for _ in range(900):
        seq += 1
        kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "odd"])
        log.append((rng.randrange(12), seq, rng.randrange(5), kind, rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b<", "[c"]) ))
    expected = {}
    for conv, _, msg, kind, role, text in log:
        own = expected.setdefault(conv, {}).setdefault(msg, [None, ""])
        own[0] = own[0] or role
        own[1] = own[1] + (text or "") if kind == "delta" else "" if kind == "regenerate" else text or ""
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    got = {}
    for r in sorted(chat.read_back(chat.format_chats(events)).collect(), key=lambda r: (r["conv_id"], r["i"])):
        got.setdefault(r["conv_id"], []).append([r["role"], r["text"]])
    assert got == {c: [[r or "", t] for r, t in m.values()] for c, m in expected.items()}


@pytest.mark.parametrize("logged", [chat.turns_as_log, lambda turns: chat.turns_as_log(turns, piece=3)])
def test_chat_digests_match_hashlib(spark, logged):
    rng = random.Random(14)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice("ab <[\\]/s>é🙂\n") for _ in range(rng.randint(0, 40))) if rng.random() > 0.1 else None) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(0, 0, "user", "again"), (0, 0, "user", "again"), (3, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["kind"] for r in logged(df).select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(logged(df))).collect()}
    for c in range(40):
        own = sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2] is not None, r[2] or ""))
        loss = "".join(x or "" for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x or ''}\n" for _, r, x in own).encode()).hexdigest()


# ---- pipeline


def test_pipeline_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(15)
    item = sentence(rng, 30, 10**6)
    passage = "\n".join(sentence(rng, 20, 10**6) for _ in range(4))
    clean = [(i, sentence(rng, 80, 10**6)) for i in range(60)]
    toxic = [(100 + i, sentence(rng, 40, 10**6) + " moronic words") for i in range(60)]
    copies = [(200, clean[0][1]), (201, clean[1][1] + " more")]
    leaks = [(300, sentence(rng, 20, 10**6) + " " + item)]
    repeats = [(400 + i, sentence(rng, 30, 10**6) + "\n" + passage) for i in range(2)]
    rows = clean + toxic + copies + leaks + repeats + ODD
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS + ", lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 160)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(seen["toxicity"]) & set(range(100, 160))
    assert passage.split("\n")[1] in seen["line dedup"][400] and passage.split("\n")[1] not in seen["line dedup"][401]
    assert not {200, 201} & set(seen["near duplicates"])
    assert 300 not in seen["decontamination"]
    assert {i for i, _ in clean} <= set(seen["decontamination"])
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert ids == set(seen["decontamination"])
