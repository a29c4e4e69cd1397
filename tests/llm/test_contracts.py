"""Every registered query on small tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tests.llm.test_dedup import components, plainly
from weftgraph.llm import queries

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghijklmnopé") for _ in range(RNG.randint(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ".", "\n"]) for _ in range(n))


BASE = [prose(RNG.choice([5, 40, 200])) for _ in range(30)]
TEXTS = {i: t for i, t in enumerate([*BASE, *BASE[:6], BASE[0].upper(), "", "", "x<|endoftext|>y </s>", "😀é " * 50, "one two", prose(2500), BASE[7] + " end"])} | {900: None}
URLS = ["http://A.Example.com/en/7/3?q#f", "https://example.com/en/1", "no url", None, "ftp://u@x.net:21/de/8#a", "http://b.example.net/de/8/4.html", "http://example.net/de/9", "http://x.org/es/5", "http://xorg/es/5", "http://c.com?a/en/", "http://c.com", "http://://x"]


def digest(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    ids = list(TEXTS)
    write = lambda name, **columns: pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    write("documents", doc_id=ids, text=[TEXTS[i] for i in ids], lang=["en"] * len(ids), source=["s"] * len(ids), n_chars=[len(TEXTS[i] or "") for i in ids])
    write("labels", doc_id=ids, quality=[int(len(TEXTS[i] or "") > 300) for i in ids], toxic=[0] * len(ids))
    write("pages", page_id=list(range(len(URLS))), url=URLS, html=[""] * len(URLS))
    write("conversations", conv_id=[1, 1, 2], turn=[0, 1, 0], role=["user", "assistant", "user"], text=["hi <|end|>", None, "x" * 2000])
    return str(folder)


def run(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries() if k != "pipeline") == list(range(1, 11))


def test_op1(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in run(spark, sf, "op1_sentencepiece"):
        ids = lib.encode(TEXTS[r.doc_id] or "")
        assert r.ids == ids and r.n_ids == len(ids) and r.decoded_chars == len(lib.decode(ids)) and r.decoded_sha256 == digest(lib.decode(ids))


def test_op2(spark, sf):
    def bits(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    ids = sorted(TEXTS)
    fps = np.array([bits(TEXTS[i]) for i in ids], np.uint64)
    label = components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = {i: (f"{int(f):016x}", ids[c]) for i, f, c in zip(ids, fps, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf, "op2_simhash")} == want


def test_op4(spark, sf):
    left = plainly({i: t or "" for i, t in TEXTS.items()}, 2, 24)
    for r in run(spark, sf, "op4_line_dedup"):
        kept = [x for k, x in enumerate((TEXTS[r.doc_id] or "").split("\n")) if k not in r.dropped_lines]
        assert "\n".join(kept) == left[r.doc_id] and r.n_dropped == len(r.dropped_lines) and r.text_sha256 == digest(left[r.doc_id])
        assert r.text_chars == (None if TEXTS[r.doc_id] is None else len(left[r.doc_id]))


def test_op5(spark, sf):
    slots = defaultdict(list)
    for r in run(spark, sf, "op5_sharding"):
        data = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == len(TEXTS)


def test_op6(spark, sf):
    groups = defaultdict(list)
    for i, t in TEXTS.items():
        groups[lower(t)].append(i)
    want = {(i, max(g), len(g), i == max(g), digest(t)) for t, g in groups.items() for i in g}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in run(spark, sf, "op6_exact_dedup")} == want


def test_op7(spark, sf):
    rows = run(spark, sf, "op7_media_columns")
    assert len(rows) == len(TEXTS)
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        full = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), digest(full), zlib.crc32(full[-16:]))
        assert r.media_bytes % 188 == 0 and r.feature.endswith("problems=")


def test_op8(spark, sf):
    lib, pieces, filled = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in run(spark, sf, "op8_packing"):
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r["length"]))
    assert set(pieces) == set(TEXTS)
    for i, own in pieces.items():
        ids, at = [*lib.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for number, held in filled.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 2048 or number == max(filled)


def test_op9(spark, sf):
    rows = run(spark, sf, "op9_quality_classifier")
    assert sorted(r.doc_id for r in rows) == sorted(TEXTS)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (len(TEXTS[r.doc_id] or "") > 300) for r in held) >= 0.8 * len(held)


def test_op10(spark, sf):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    for r in run(spark, sf, "op10_url_filters"):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", URLS[r.page_id] or "")
        host, path = (lower(found[1]), found[2]) if found else ("", "")
        fits = sorted((-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r.host, r.path, r.rule) == (host, path, fits[0][1] if fits else None)
        assert r.verdict == fits[0][2] if fits else r.verdict in ("allow", "block")


def test_op10_sql(spark, tmp_path):
    """Reputation of many sites under addresses, ports, users and suffixes of two labels, against the SQL."""
    rng = random.Random(3)
    hosts = ["a.co.uk", "b.a.co.uk", "c.com", "x.c.com:80", "u@y.c.com", "1.2.3.4", "1.2.3.5:8080", "[::1]", "net", "org.", "", "d.org", "e.d.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['', '00'])}{i}{rng.choice(['', '/', '.html', '?q'])}" for i in range(300)] + [None, "x", "http://c.com/fr/7", "http://c.com/fr/7"]
    labels = [(i, rng.choice([0, 1, 1, None]) if "c.com" in urls[i] else 0, rng.choice([0, 0, None])) for i in range(0, 300, 2)]
    pq.write_table(pa.table({"page_id": range(len(urls)), "url": urls, "html": urls}), tmp_path / "pages.parquet")
    pq.write_table(pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*labels))))), tmp_path / "labels.parquet")
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = {r[0]: r[1:] for r in db.execute(f"select page_id, host, path, rule, verdict from ({queries.oracle_sql()['op10_url_filters']})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run(spark, str(tmp_path), "op10_url_filters")}
    assert got == want and {v for _, _, rule, v in got.values() if rule is None} == {"allow", "block"}


def test_pipeline(spark, sf):
    rows = run(spark, sf, "pipeline")
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r["length"]
    assert rows and all(n == 2048 for i, n in held.items() if i != max(held)) and {r.doc_id for r in rows} <= set(TEXTS)
