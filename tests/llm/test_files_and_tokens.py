"""Archives, token files, packing, shared helpers and the pipeline: exact round trips and invariants."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import common, packing, repair, tokens, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = [" ", "  ", "\n", "\n\n", "a", "ab", "The", "'s", "'re", "'", "1", "23", ".", "!?", "_", "é", "ñ", "ª", "²", "\t", "\xa0", "<|endoftext|>", "’", "—", "×", "汉", "🙂", "​"]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 90, 300, 700, 1500])))) for i in range(90)]
    data += [(90, None), (91, ""), (None, "no id"), (None, "no id"), (92, "twice"), (92, "twice"), (93, " ".join(words * 40)), (94, "<|endoftext|> x   y\n z ")]
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(docs):
    names = ["start", "length", "rank", "bucket", "u", "shard", "ids_crc32", "sequence_id", "offset", "block", "value", "n_tokens", "total"]
    return docs.select("*", *[F.lit("extra").alias(n) for n in names])


def ids_of(text, end):
    enc = tokens.Encoder.of(PATH)
    return np.array([*enc.whole.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_encoder_equals_the_library():
    enc, rng = tokens.Encoder.of(PATH), random.Random(1)
    assert enc.by_word
    for _ in range(8000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 10)))
        assert enc.encode(t) == np.array(enc.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "WORD_BYTES", 2000)
    monkeypatch.setattr(tokens, "PRE_TOKEN_BYTES", 2000)
    enc, rng = tokens.Encoder(PATH), random.Random(2)
    for _ in range(200):
        word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 3))) + rng.choice(["", "", ".", ",\nx", "'s", "_1"])
        t = " ".join(word() for _ in range(12))
        assert enc.encode(t) == ids_of(t, 0)[:-1].tobytes(), repr(t)
        assert enc.words.held <= 2400 and enc.pre_tokens.held <= 2400


def test_packing(docs, clashing):
    p = packing.PackingParams(PATH)
    got = packing.pack(docs, p).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(ids_of(r["text"], 0))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(ids) == r["doc_tokens"] for ids in want[r["doc_id"]])
    for doc, own in want.items():
        covered = sorted((r["start"], r["length"]) for r in pieces[doc])
        assert sum(n for _, n in covered) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for start, n in covered:
                assert start == at
                at += n
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= rows[0]["tier"] <= 1024 and len({r["tier"] for r in rows}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024 + 0.02 * sum(r["length"] for r in got)
    assert collected(packing.pack(clashing, p)) == collected(packing.pack(docs, p))
    assert packing.pack(docs.limit(0), p).count() == 0


def test_plan_places_every_remainder_once():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 64): rng.randint(1, 2000) for _ in range(rng.randint(1, 40))}
        groups = packing.plan(counts, 64, (64, 32, 16))
        whole, head, tail = (defaultdict(list) for _ in range(3))
        for g in groups:
            assert g.gap >= 0 and g.tier in (64, 32, 16) and (g.tier == 64 or not g.gap)
            for lot in g.lots:
                assert lot.count == g.count
                (whole, head, tail)[lot.part][lot.length].append((lot.rank, lot.rank + lot.count))
        for length, n in counts.items():
            for cut in (head, tail):
                spans = sorted(whole[length] + cut[length])
                assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n
        assert len(groups) < 4000


def test_repair_round_trip(spark, docs, clashing):
    p = repair.RePairParams(PATH, block_ids=3000, shard_bytes=40_000)
    got = repair.round_trip(docs, p).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    at, starts = 0, sorted((r["start"], r["n_tokens"]) for r in got)
    for start, n in starts:
        assert start == at
        at += n
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [r["doc_id"] for r in rows]
    want = sorted(((r["doc_id"], len(i), zlib.crc32(i.tobytes())) for r in rows for i in [ids_of(r["text"], 2)]), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == want
    assert len({r["shard"] for r in got}) > 1
    assert sorted((r["doc_id"], r["start"]) for r in repair.round_trip(clashing.filter("doc_id < 40"), p).collect()) == sorted((r["doc_id"], r["start"]) for r in repair.round_trip(docs.filter("doc_id < 40"), p).collect())
    assert repair.round_trip(docs.limit(0), p).count() == 0


def test_smallest_id_is_no_null(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a"), (None, "b c"), (None, None), (0, "d")], "doc_id long, text string")
    got = repair.round_trip(df, repair.RePairParams(PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, least, 0] and got[2]["ids_crc32"] == zlib.crc32(ids_of("a", 2).tobytes())


def test_running_totals_equal_a_window(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["before"] for r in common.running_total(df, "id", "v", "before", 32).collect()}
    assert got == {i: sum(k % 7 for k in range(i)) for i in range(1000)}
    assert common.running_total(df.limit(0), "id", "v", "before").count() == 0


def test_scratch_asks_for_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(far, "x")
    df = common.written(spark.range(3), "gone")
    assert df.count() == 3
    common.discard(df)
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE_NOT_EXIST"):
        spark.read.parquet(df._written_to).count()


def test_grammar_is_exact_and_random_access():
    rng = np.random.default_rng(4)
    p = repair.RePairParams(PATH, rounds=6, rules_a_round=50, min_count=2)
    for base in (50, 70_000):
        for _ in range(30):
            lengths = rng.integers(1, 60, size=rng.integers(1, 20))
            ids = (rng.zipf(1.6, size=lengths.sum()) % base).astype(np.uint32)
            g = repair.compress(ids, lengths, base, p)
            data = repair.to_block(g, np.arange(len(lengths)), 0, lengths, 3, 17) + b"\n"
            (block,) = repair.read_blocks(data)
            assert (block.ids() == ids).all() and (block.shard, block.before) == (3, 17)
            ends = np.cumsum(lengths)
            for k in range(len(lengths)):
                own = ids[ends[k] - lengths[k] : ends[k]]
                assert (block.decode(k) == own).all()
                a = int(rng.integers(0, lengths[k]))
                n = int(rng.integers(0, lengths[k] + 3))
                assert (block.decode(k, a, n) == own[a : a + n]).all()
    same = repair.compress(np.tile(np.array([5, 6, 7], dtype=np.uint32), 1000), np.array([3000]), 50, p)
    assert len(same.symbols) < 200
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises(ValueError):
        list(repair.read_blocks(bytes(damaged)))


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    p = repair.RePairParams(PATH)
    passage = rng.permutation(40_000)[:1000].astype(np.uint32)
    g = repair.compress(np.tile(passage, 1000), np.full(1000, 1000), 50_257, p)
    assert len(g.symbols) == 1000 and g.length.max() == 1000
    ids, lengths = (rng.zipf(1.3, size=30_000) % 300).astype(np.uint32), np.full(300, 100)
    g = repair.compress(ids, lengths, 50_257, p)
    owner = np.searchsorted(g.first, np.arange(len(g.symbols)), "right")
    inner = owner[1:] == owner[:-1]
    pairs, n = np.unique(np.stack([g.symbols[:-1][inner], g.symbols[1:][inner]]), axis=1, return_counts=True)
    assert n.max() < p.min_count and len(g.left) > 100
    assert (repair.expand(g.symbols, g, repair.expansions(g)) == ids).all()


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>" + "shared payload " * 20
    data = [(1, "http://a/\r\nx: y", "é" * 70), (2, None, None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"), (9, "u", big), (7, "u", big), (8, "u", big), (10, "u", "x" * 300_000), (None, "u", "null id " * 20)]
    df = spark.createDataFrame(data, PAGES).withColumn("payload_bytes", F.lit("extra")).withColumn("first_id", F.lit(0))
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert set(got) == {r[0] for r in data}
    for page, _, html in data:
        payload = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if page in (8, 9) else ("response", None))
    assert "\r" not in got[1]["url"] and warc.round_trip(df.limit(0)).count() == 0


def test_gaps_are_logged_and_lost_records_an_error(spark, tmp_path, monkeypatch):
    data, _ = archive()
    hurt = data[:400] + b"\x00" * 300 + data[700:]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(hurt)
    records = warc.recovered(spark, str(tmp_path / "in"), str(tmp_path / "log"))
    gaps = spark.read.json(str(tmp_path / "log")).collect()
    assert 0 < records.count() < 30 and gaps and all(0 <= g["start"] < g["end"] <= len(hurt) and g["reason"] for g in gaps)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(50)], PAGES)
    write = warc.write
    monkeypatch.setattr(warc, "write", lambda *a: write(*a) + 1)
    with pytest.raises(RuntimeError, match="51 records were written and 50 read back"):
        warc.round_trip(pages)


def test_repeated_pages_get_a_record_each(spark):
    long = "many bytes " * 200_000
    data = [(1, "u", long)] * 2 + [(2, "u", long)] + [(3, "u", "x")] * 3 + [(None, None, None)] * 2
    got = warc.round_trip(spark.createDataFrame(data, PAGES))
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()), key=repr)
    assert kinds == sorted([(1, "response", None)] * 2 + [(2, "revisit", 1)] + [(3, "response", None)] * 3 + [(None, "response", None)] * 2, key=repr)


def archive(n=30, plain=False):
    rng = random.Random(7)
    out, spans = b"", []
    for i in range(n):
        payload = bytes(rng.randrange(32, 127) for _ in range(rng.randint(0, 900)))
        rec = warc.record(i, "u", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
        member = rec if plain else warc.gzip_member(rec) + warc.EMPTY_MEMBER
        spans.append((len(out), len(out) + len(member)))
        out += member
    return out, spans


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    data, spans = archive(plain=plain)
    if not plain:
        assert gzip.decompress(data).count(b"WARC/1.1") == 30
    assert [r["page_id"] for r in warc.salvage(data)] == list(range(30))
    rng = random.Random(5)
    for _ in range(60):
        hurt = bytearray(data)
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.randint(1, 700))
        kind = rng.choice(["noise", "cut", "insert"])
        if kind == "noise":
            hurt[a:b] = bytes(rng.randrange(256) for _ in range(b - a))
        elif kind == "cut":
            del hurt[a:b]
        else:
            hurt[a:a] = bytes(rng.randrange(256) for _ in range(50))
        if bytes(hurt) == data:
            continue
        rows = list(warc.salvage(bytes(hurt)))
        pages = [r["page_id"] for r in rows if r["kind"] == "record" and r["page_id"] is not None]
        stop = a if kind == "insert" else b
        untouched = [i for i, (s, e) in enumerate(spans) if e <= a or s >= stop]
        assert set(untouched) <= set(pages) and pages == sorted(set(pages))
        gaps = [(r["start"], r["end"]) for r in rows if r["kind"] == "gap"]
        assert all(0 <= s < e <= len(hurt) for s, e in gaps)
        # a cut from one header into another can leave nothing that is wrong
        if sum(r["kind"] == "record" for r in rows) < 30 and kind != "cut":
            assert gaps
    assert list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"junk")] == ["gap"]


def test_salvage_of_a_plain_archive_with_a_long_damaged_first_record():
    payloads = [b"a" * 9000, b"\x1f\x8b\x08 no member " * 9, gzip.compress(b"not a record"), b"last"]
    recs = [warc.record(i, "u", x, len(x), hashlib.sha256(x).hexdigest(), None) for i, x in enumerate(payloads)]
    for broken in range(3):
        data = b"".join(b"X" + r[1:] if i == broken else r for i, r in enumerate(recs))
        assert {r["page_id"] for r in warc.salvage(data) if r["kind"] == "record"} == {0, 1, 2, 3} - {broken}
    mixed = recs[0] + warc.gzip_member(recs[1]) + b"noise" + recs[2] + warc.gzip_member(recs[3])
    rows = list(warc.salvage(mixed))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 1, 2, 3]
    assert [mixed[r["start"] : r["end"]] for r in rows if r["kind"] == "gap"] == [b"noise"]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_one_member_for_all_records(level):
    plain, spans = archive(200, plain=True)
    data = warc.gzip_member(plain, level)
    assert [r["page_id"] for r in warc.salvage(data)] == list(range(200))
    for at in (len(data) * 3 // 4, len(data) - 6):  # within the records, and the checksum
        hurt = data[:at] + bytes([data[at] ^ 255, data[at + 1] ^ 255]) + data[at + 2 :]
        for torn in (hurt, data[:at]):
            rows = list(warc.salvage(torn))
            pages = [r["page_id"] for r in rows if r["kind"] == "record"]
            assert pages == sorted(set(pages)) and len(pages) > 130 and any(r["kind"] == "gap" for r in rows)
            assert all(r["reason"] for r in rows)
    # a member whose only record has nothing that confirms it stays a gap
    one = bytearray(warc.gzip_member(warc.record(1, "u", b"", 200, "0" * 64, 0)))
    one[-6] ^= 1
    assert [r["kind"] for r in warc.salvage(bytes(one))] == ["gap"]


def foreign(kind, block, **fields):
    """A record as other writers make it."""
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0>", "WARC-Target-URI: http://a/", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_salvage_of_other_writers_archives():
    def b32(name, x):
        return f"{name}:{base64.b32encode(hashlib.new(name, x).digest()).decode()}"

    body, http = b"<p>page</p>", "application/http; msgtype=response"
    sent = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n" + body[:4] + b"\r\n7\r\n" + body[4:] + b"\r\n0\r\n\r\n"
    good = [
        foreign("response", sent, WARC_Payload_Digest=b32("sha1", body), WARC_Block_Digest=b32("sha1", sent), Content_Type=http),
        foreign("response", sent, WARC_Payload_Digest=b32("sha1", body), Content_Type=http),
        foreign("response", chunked, WARC_Payload_Digest=b32("sha1", body), Content_Type=http),
        *(foreign("response", body, WARC_Payload_Digest=x) for x in (b32("sha256", body), f"sha256:{hashlib.sha256(body).hexdigest().upper()}", f"md5:{hashlib.md5(body).hexdigest()}", "blake9:XYZ")),
        foreign("revisit", b"", WARC_Payload_Digest=b32("sha1", body)),
    ]
    others = [foreign(k, b"a: b") for k in ("warcinfo", "request", "metadata")]
    for pack in (bytes, warc.gzip_member):
        rows = list(warc.salvage(b"".join(pack(x) for x in [others[0], *good, *others[1:]])))
        assert [r["kind"] for r in rows] == ["record"] * len(good), rows
        assert rows[0]["payload_bytes"] == len(body) and rows[0]["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert [r["reason"] for r in warc.salvage(pack(others[1].replace(b"request", b"reqXest")))] == ["unknown record type"]
        for x in good[:6]:
            assert [r["kind"] for r in warc.salvage(pack(x.replace(b"<p>p", b"<p>q")))] == ["gap"], x


def test_ranks_equal_a_window(spark):
    from pyspark.sql.window import Window

    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"), common.unit_hash(F.lit(1), "id").alias("u"))
    got = common.ranked(df.withColumn("b", F.floor(F.col("u") * 16)), "g", "b", ["u", "id"])
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")) - 1).withColumn("t", F.count("*").over(Window.partitionBy("g")))
    assert got.join(want, "id").filter((F.col("rank_") != F.col("w")) | (F.col("total_") != F.col("t"))).count() == 0 and got.count() == 2000


def test_lookup_of_hot_keys(spark):
    left = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 4000).cast("long").alias("k"))
    table = left.groupBy("k").agg(F.count("*").alias("n")).filter("k < 3000").withColumn("v", F.col("k") * 2)
    got = common.lookup(left, "k", table, "v", "n", 20000, F.col("id"))
    assert got.count() == 20000
    assert got.filter(~F.col("v").eqNullSafe(F.when(F.col("k") < 3000, F.col("k") * 2))).count() == 0
    assert got.columns == ["id", "k", "v"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    en = "the house stood near the river and the people who lived there were happy with their work".split()
    fr = "la maison se trouvait près de la rivière et les gens qui y vivaient étaient contents de leur travail".split()
    passage = " ".join("".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(30))
    data = []
    for i in range(60):
        w = (en if i % 2 else fr) * 8
        rng.shuffle(w)
        data.append((i, " ".join(w), "en" if i % 2 else "fr", "s", 0, "extra"))
    data += [(60, data[3][1], "en", "s", 0, "e"), (61, data[5][1] + " mail me at some.one@example.org", "en", "s", 0, "e"), (62, data[7][1] + " " + passage, "en", "s", 0, "e"), (63, None, None, None, None, None), (64, "123", "en", "s", 3, "e")]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rank string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = common.written(docs, "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank"]
        seen.append({r["doc_id"] for r in docs.collect()})
    assert {63, 64}.isdisjoint(seen[0]) and set(range(60)) <= seen[0]
    assert 60 not in seen[1] and 3 in seen[1]
    assert 62 not in seen[2] and seen[2] == seen[3]
    assert "some.one@" not in " ".join(r["text"] for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == seen[3] and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema, item = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"
    words = "the house stood near the river and the people who lived there were happy".split()
    odd = [(1, " ".join(words * 9), "en", "s", 1)] * 4 + [(None, None, None, None, None)] * 3 + [(2, "", "en", "s", 0), (3, " ".join(words[::-1] * 20_000), "en", "s", 9), (None, "quite another text without an id, about a mill and its wheel", "en", "s", 9)]
    for k, (rows, items) in enumerate([([], []), (odd, []), ([], [(1, "a b c")]), (odd, [(None, None), (2, "")])]):
        where = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame(items, item).write.parquet(f"{where}/benchmark.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        if not rows:
            assert got == []
            continue
        # of the repeated rows one stays, those without a letter go
        assert {r["doc_id"] for r in got} == {1, 3, None} and sum(r["doc_id"] == 1 and r["start"] == 0 for r in got) == 1
        assert sum(r["length"] for r in got if r["doc_id"] == 3) == len(ids_of(odd[8][1], 0))
