"""Exact, near and line dedup; sharding."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, line_dedup, near_dedup, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, keep_id string"
ROWS = [(1, "Same text\nhere", "a", "x"), (2, "same TEXT\nhere", "b", "y"), (3, "", "c", None), (4, None, None, "z"), (5, "Äpfel", "d", "w"), (6, "äpfel", "d", "w"), (None, "same text\nhere", None, None), (7, "long " * 3000, "e", "v"), (8, "long " * 2999 + "lonG ", "e", "v"), (8, "long " * 2999 + "lonG ", "e", "v"), (None, "alone", None, None)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame(ROWS, SCHEMA), block_bytes=16).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    want = Counter()
    import hashlib

    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_bits():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for text in ["", " \n", "one", "one Two three", "a b c d", "A B c D e é\u00a0f g " * 20]:
        assert simhash.fingerprint(text) == plain(text)


def test_anchors_cover():
    anchors, rng = simhash.Anchors(2), np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(500):
        for j in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(j))
    sets = []
    for fps in (a, b):
        own = defaultdict(set)
        for i, x in zip(*anchors.of(fps)):
            own[i].add(x)
        sets.append(own)
    assert all(sets[0][i] & sets[1][i] for i in range(500))


def components(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_links_of_crowded_anchors(spark):
    rng = np.random.default_rng(3)
    # all in the bits that no anchor looks at: every fingerprint meets every other
    fps = np.unique(rng.integers(0, 1 << 18, 150, dtype=np.uint64) << np.uint64(46))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = components(near)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for held in (8, 4096):
        mine = np.eye(len(fps), dtype=bool)
        for r in simhash.near_links(nodes, most_held=held).collect():
            mine[place[r.a], place[r.b]] = mine[place[r.b], place[r.a]] = True
        assert (components(mine) == want).all()


def test_near_duplicates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    base = [" ".join(word() for _ in range(400)) for _ in range(6)]
    docs = [(10 * i + k, t if k == 0 else t + " " + word(), "x") for i, t in enumerate(base) for k in range(3)] + [(200, None, "n"), (201, "", "n"), (None, base[0], "n")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, fp string"), most_held=4).collect()
    fps = np.array([simhash.fingerprint(t or "") for _, t, _ in docs], np.uint64)
    label = components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    least = {c: min(d[0] for d, x in zip(docs, label) if x == c and d[0] is not None) for c in set(label)}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d[0], least[c]) for d, c in zip(docs, label))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_fingerprints_in_parts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    base, texts = [word() for _ in range(60)], []
    for i in range(40):
        text = base.copy()
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2])):
            text[at] = word()
        texts.append(" ".join(text))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [near_dedup.shingles(t) for t in texts]
    # what meets in a fingerprint is compared; texts that meet in none are not near
    near = np.array([[near_dedup.alike(a, b, 0.8) for b in sets] for a in sets])
    want = components(near)
    for most in (1 << 20, 2000):
        got = {r.doc_id: r.component_id for r in near_dedup.near_documents(docs, most_bytes=most).collect()}
        assert [got[i] for i in range(40)] == want.tolist()


def test_near_stage_meets_at_anchors_of_fingerprints(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    for n in (1, 4, 255, 300):
        cast, got = near_dedup.votes(hashes := draw(n)), near_dedup.majority(hashes)
        ones = np.unpackbits(cast.view(np.uint8).reshape(n, -1, 8), axis=2, bitorder="little").sum(0, dtype=np.int64).reshape(-1, 64)
        assert [[int(x) >> b & 1 for b in range(64)] for x in got] == (ones * 2 > n).astype(int).tolist()
    # pairs of 40 hashes each, 36 in common: Jaccard similarity 0.82; each pair apart from all others
    marks, node = [], 0
    for _ in range(200):
        hashes = draw(44)
        for part in (hashes[:40], hashes[4:]):
            marks.append((node, near_dedup.majority(part).view(np.int64).tolist()))
            node += 1
    marks = spark.createDataFrame(marks, "name long, fps array<long>")
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup.meetings(marks, 0, near_dedup.FINGERPRINTS).collect()}
    pairs = {(i, i + 1) for i in range(0, 400, 2)}
    assert links <= pairs and len(links) >= 198
    # one fingerprint at its anchors meets some of them only, and only by that fingerprint's anchors
    one = near_dedup.meetings(marks, 0, 1).distinct().count()
    assert 0 < one < 120
    # rows that are one by name already give no links; keys go on over batches
    named = marks.withColumn("name", F.expr("if(name < 200, -1, name)"))
    assert {tuple(sorted((r.a, r.b))) for r in near_dedup.meetings(named, 0, 8).collect()} <= {p for p in pairs if p[0] >= 200}
    alike = spark.createDataFrame([(i, near_dedup.majority(hashes).view(np.int64).tolist()) for i in range(90)], "name long, fps array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        reach = near_dedup.min_reachable(near_dedup.meetings(alike, 0, 1, 0), "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.id, r.component) for r in reach} == {(i, 0) for i in range(90)}


def test_what_meets_in_one_anchor():
    rng = np.random.default_rng(9)
    for n in (1, 2, 40, 64, 65, 300):
        keys = np.sort(rng.integers(0, 3, n))
        centres = rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64)
        checks = centres[rng.integers(0, 4, n)]
        for _ in range(22):
            checks[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        near = (np.bitwise_count(checks[:, None] ^ checks[None, :]).sum(-1, dtype=np.int64) <= near_dedup.MOST_BITS) & (keys[:, None] == keys[None, :])
        mine = np.eye(n, dtype=bool)
        for i, j in zip(*near_dedup.met(keys, np.arange(n), checks)):
            mine[i, j] = mine[j, i] = True
        assert (components(mine) == components(near)).all()


def test_near_stage_of_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    docs, kinds = [], [0, 0, 1, 2, 3, 4, 6, 8, 11, 14]  # words changed of 400: similarities around and over 0.8
    for i in range(12):
        base = [word() for _ in range(400)]
        for k, n in enumerate(kinds):
            text = base.copy()
            for at in rng.sample(range(400), n):
                text[at] = word()
            docs.append((100 * i + k, " ".join(text)))
    docs += [(5000, ""), (5001, None), (5002, "few words"), (5003, "Few  words"), (None, docs[0][1])]
    sets = [near_dedup.shingles(t or "") for _, t in docs]
    near = np.array([[near_dedup.alike(a, b, 0.8) for b in sets] for a in sets])
    fps = np.array([simhash.fingerprint(t or "", 5) for _, t in docs], np.uint64)
    assert (near & (np.bitwise_count(fps[:, None] ^ fps[None, :]) > 4)).any()
    label = components(near)
    least = {c: min(d[0] for d, x in zip(docs, label) if x == c and d[0] is not None) for c in set(label)}
    want = {d[0] for d, c in zip(docs, label) if d[0] == least[c]}
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want
    assert corpus_pipeline.one_of_each(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, times):
    t = list(text)
    for _ in range(times):
        i, kind = rng.randrange(len(t) + 1), rng.random()
        if kind < 0.34 or not t:
            t.insert(i, rng.choice("abé"))
        elif kind < 0.67:
            t.pop(min(i, len(t) - 1))
        else:
            t[min(i, len(t) - 1)] = rng.choice("abé")
    return "".join(t)


def test_within_edits(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 24)))
        pairs.append((a, changed(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (0, 2, 4):
        assert all(r.near == (distance(r.a, r.b) <= k) for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), k).alias("near")).collect())


def plainly(docs, edits, least):
    seen, out = [], {}
    for d in sorted(docs):
        keep = []
        for line in docs[d].split("\n"):
            if len(line) < least or all(distance(line, x) > edits for x in seen):
                keep.append(line)
            if len(line) >= least:
                seen.append(line)
        out[d] = "\n".join(keep)
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(4, 30))) for _ in range(30)]
    docs = {i: "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))) for i in range(60)}
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs.items()], "doc_id long, text string, key string, places int")
    got = line_dedup.dedup_lines(df, 2, 6)
    assert {r.doc_id: r.text for r in got.collect()} == plainly(docs, 2, 6)
    assert got.columns == [*df.columns, "dropped_lines"]


def test_line_dedup_partner_that_meets_one_line(spark):
    docs = {1: "abcdefgh01234567890123456", 2: "abcdefghijklZmnopqrstYuvwx", 3: "abcdefghijklmnopqrstuvwx"}
    assert distance(docs[2], docs[3]) == 2 and plainly(docs, 2, 24)[3] == ""
    got = line_dedup.dedup_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == plainly(docs, 2, 24)


def test_line_dedup_of_crowded_keys(spark):
    # lines that share a long beginning: one key holds all of them, and most are not near each other
    rng = random.Random(11)
    docs = {i: "all of these lines begin in the very same way " + changed(rng, "".join(rng.choice("etan") for _ in range(7)) * 2, rng.choice([0, 1])) for i in range(120)}
    docs |= {200 + i: changed(rng, docs[rng.randrange(120)] + "😀é", rng.choice([0, 1, 2, 3])) for i in range(60)}
    got = line_dedup.dedup_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == plainly(docs, 2, 24)


def test_line_dedup_columns_and_ids(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line, "x", [7]), (2, line, "y", None)], "doc_id int, text string, dropped_lines string, `odd name` array<int>")
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.dropped_lines, r["odd name"]) for r in got] == [(1, line, [], [7]), (2, "", [0], None)]
    with pytest.raises(TypeError):
        line_dedup.dedup_lines(df.select(F.col("doc_id").cast("string"), "text"))


def test_line_dedup_edges(spark):
    line = "a line that is long enough to count"
    rows = [(2, line), (1, f"{line}\nshort\n{line}"), (3, None), (4, ""), (None, line), (5, line + "x" * 9000), (5, line + "x" * 9000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, f"{line}\nshort"), (2, ""), (3, None), (4, ""), (None, ""), (5, line + "x" * 9000), (5, line + "x" * 9000)])
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(203)] + [(7, "again"), (None, None), (None, None)], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 206 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_bounded_loads_move_little():
    points, owners = sharding.ring(8)
    grown, owned = sharding.ring(9)
    assert set(points) <= set(grown)
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 20000)
    home = owners[np.searchsorted(points, keys) % len(points)]
    new = owned[np.searchsorted(grown, keys) % len(grown)]
    assert set(new[new != home]) == {8} and (new != home).mean() < 0.2
    counts = Counter((np.searchsorted(points, keys) % len(points)).tolist())
    for slack in (0.0, 0.1):
        room = sharding.capacities(len(keys), 8, slack)
        pieces = sharding.allot(counts, owners, room)
        load = Counter()
        for arc, lo, hi, shard, base in pieces:
            assert base == load[shard]
            load[shard] += hi - lo
        assert all(load[s] <= room[s] for s in range(8)) and sum(load.values()) == len(keys)
