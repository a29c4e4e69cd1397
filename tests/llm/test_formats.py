"""Chat formatting, media streams, URL filters, the pipeline."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, media, url_filter
from weftgraph.llm.media import PACKET


def test_fold_of_events(spark):
    log = [
        ("c", 1, 1, "delta", "user", "Hel"), ("c", 1, 2, "delta", None, "lo"), ("c", 2, 3, "delta", "assistant", "wrong"), ("c", 2, 4, "regenerate", None, ""), ("c", 2, 5, "delta", None, "ri"), ("c", 2, 6, None, None, "ght"),
        ("c", 1, 7, "edit", None, "Hi"), ("d", 1, 1, "delta", "assistant", None), (None, 1, 1, "delta", None, "[INST]"),
    ]
    events = spark.createDataFrame(log, "conv_id string, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.fold(events).collect()}
    assert got == {("c", 1): ("user", "Hi"), ("c", 2): ("assistant", "right"), ("d", 1): ("assistant", ""), (None, 1): ("", "[INST]")}
    back = {r.conv_id: r for r in chat_format.parse(chat_format.format_chats(events)).collect()}
    assert [tuple(t) for t in back["c"].turns] == [("user", "Hi"), ("assistant", "right")] and back["c"].loss_texts == ["right"]
    assert [tuple(t) for t in back[None].turns] == [("", "[INST]")]
    assert chat_format.format_chats(events.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST] <|turn|>", r"\<s>\\", "<|end|><\\|text|>", "<<s>", "[[INST]", "", "a\nb", "<s", "é<s>😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("back", chat_format.unescape(F.col("e")))
    for r in df.collect():
        assert r.back == r.t
        assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>"))


@pytest.mark.parametrize("size", [0, 192, 3840, 3840 * 9 + 192, 192 * 500, *range(192, 192 * 12, 192)])
def test_stream_round_trip(size):
    payload = os.urandom(size)
    stream = media.mux(payload)
    got = media.demux(stream)
    assert got["payload"] == payload and not got["problems"] and len(stream) % 188 == 0
    assert got["pts"] == [i * media.UNIT_TICKS for i in range(-(-size // media.UNIT_BYTES))]
    assert got["access_units"] == list(range(0, len(got["pts"]), media.ACCESS_EVERY))
    assert all(stream[b] == media.SYNC for b in got["access_bytes"])


def test_damaged_streams():
    stream = media.mux(os.urandom(192 * 60))
    lost = stream[: 188 * 12] + stream[188 * 13 :]
    assert "continuity" in media.demux(lost)["problems"]
    assert media.demux(stream[:-1])["problems"] == ["length"]
    assert media.demux(b"\0" + stream[1:])["problems"] == ["sync"]
    assert media.demux(stream[:20] + b"\x55" + stream[21:])["problems"] == ["tables"]


def test_media_frames(spark):
    docs = spark.createDataFrame([(1, "abc", 5), (2, None, 6), (1, "abc", 5), (3, "é" * 40_000, 7)], "doc_id long, text string, packets int")
    rows = docs.select("doc_id", media.padded(F.col("text")).alias("payload"))
    got = media.read(media.store(rows)).orderBy("doc_id").collect()
    assert [r.payload_bytes for r in got] == [192, 192, 192, 80064]
    assert got[0].media_sha256 == got[1].media_sha256 != got[2].media_sha256 and not any(r.problems for r in got)
    assert media.read(media.store(rows.limit(0))).count() == 0


RULES = (url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "org", "/es/"))


def test_urls_and_rules(spark):
    cases = {
        "https://A.Example.COM/en/7?x#y": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://b.com/en/1": ("b.com", "/en/1", "com/en/", "block"),
        "http://b.com?en/1": ("b.com", "", None, "allow"),
        "ftp://x.org/es/#/": ("x.org", "/es/", "org/es/", "block"),
        "http://xorg/es/": ("xorg", "/es/", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://h.net/a://b": ("h.net", "/a://b", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = url_filter.judge(pages, none, RULES, most_bad=0.9).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())
    assert url_filter.judge(pages.limit(0), none, RULES, most_bad=0.9).count() == 0


def test_reputation_shrinks(spark):
    rows = [("http://bad.spam.net/", True)] * 40 + [("http://one.spam.net/", True)] + [("http://one.fine.org/", True)] + [(f"http://h{i % 5}.fine.org/", i % 20 == 0) for i in range(200)] + [("http://x.net/", None)]
    outcomes = spark.createDataFrame(rows, "url string, bad boolean")
    urls = ["http://bad.spam.net/", "http://one.spam.net/", "http://new.spam.net/", "http://one.fine.org/", "http://new.fine.org/", "http://new.co.uk/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bound = {r.host: r.bad_bound for r in url_filter.judge(pages, outcomes, (), most_bad=0.5).collect()}
    assert bound["bad.spam.net"] > 0.8 and bound["new.spam.net"] > 0.5 > bound["one.fine.org"]
    assert bound["one.spam.net"] > bound["one.fine.org"]
    assert bound["new.fine.org"] < 0.3


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "x.shop.co.uk": ("co.uk", "shop.co.uk"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.suffix_of(F.col("h")).alias("s"), url_filter.domain_of(F.col("h")).alias("d"))
    assert {r.h: (r.s, r.d) for r in df.collect()} == hosts


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    text = lambda k: f"Chapter {k} tells of quiet rivers and of hills.\nIt was written in the year {1000 + 37 * k}, far from here, by number {k * k}."
    rows = [(i, text(i), "en", "s", 0) for i in range(30)] + [(100 + i, text(i), "en", "s", 0) for i in range(5)] + [(200 + i, "WIN!! CASH!! " * 15, "en", "s", 0) for i in range(12)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i < 300], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = corpus_pipeline.durable(kept)
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & set(range(200, 212)) and set(range(30)) <= ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


def test_streamed_logs_fold_back(spark):
    turns = [(1, i, role, text) for i, (role, text) in enumerate([("user", "x" * 5000), (None, None), ("assistant", ""), ("assistant", "é😀" * 99), ("user", "a"), ("assistant", "end")])]
    log = chat_format.stream_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["regenerate"] == 6 and kinds["edit"] == 2 and kinds["delta"] > 20
    assert [(r.role, r.text) for r in chat_format.fold(log).orderBy("message").collect()] == [(a or "", b or "") for _, _, a, b in turns]


def test_damaged_streams_are_read():
    rng = random.Random(9)
    for _ in range(2000):
        raw = bytearray(media.mux(rng.randbytes(rng.choice([0, 100, 5000]))))
        for _ in range(rng.randint(1, 5)):
            at = PACKET * rng.randrange(len(raw) // PACKET)
            if rng.random() < 0.2 and len(raw) > PACKET:
                del raw[at : at + PACKET]
            else:
                raw[at + rng.choice([1, 2, 3, 4, 5, 6, rng.randrange(PACKET)])] = rng.randrange(256)
        media.demux(bytes(raw))
    payload = rng.randbytes(9000)
    packets = [media.mux(payload)[i : i + PACKET] for i in range(0, len(media.mux(payload)), PACKET)]
    twice = b"".join(p + p if p[1] & 0x1F == media.ES_PID >> 8 and p[2] == media.ES_PID & 255 else p for p in packets)
    got = media.demux(twice)
    assert got["payload"] == payload and not got["problems"]
    own = [i for i, p in enumerate(packets) if p[2] == media.ES_PID & 255]
    assert media.demux(b"".join(p for i, p in enumerate(packets) if i != own[3]))["problems"]


def test_media_replaces_columns_of_its_names(spark):
    rows = spark.createDataFrame([(1, bytearray(b"x" * 192), "old", "kept", "old")], "doc_id long, payload binary, media string, `odd name` string, pts string")
    got = media.read(media.store(rows)).collect()[0]
    assert got["odd name"] == "kept" and got.payload_bytes == 192 and got.pts == [0]


def test_sites_of_hosts(spark):
    hosts = {"a.example.co.uk": ("co.uk", "example.co.uk"), "u:p@www.a.com:80": ("com", "a.com"), "1.2.3.4:8080": ("", "1.2.3.4"), "[::1]:80": ("", "[::1]"), "com.": ("com", "com"), "": ("", "")}
    site = url_filter.site_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.suffix_of(site).alias("s"), url_filter.domain_of(site).alias("d")).collect()
    assert {r.h: (r.s, r.d) for r in got} == hosts
    three = url_filter.domain_of(F.lit("www.x.city.kobe.jp"), ("kobe.jp", "city.kobe.jp"))
    assert spark.range(1).select(three).first()[0] == "x.city.kobe.jp"


def test_suffix_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// note\ncom\nco.uk\n*.ck\n!www.ck\n\ncity.kobe.jp\n")
    assert url_filter.read_suffixes(spark, str(tmp_path / "list.txt")) == ("city.kobe.jp", "co.uk")
