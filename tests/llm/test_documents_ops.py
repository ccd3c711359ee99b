"""Operators over documents: nulls, empty and long texts, ties and repeated rows, empty tables, clashing names, brute force."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaykit.llm import bands, langid, licenses, pii, sharding, simhash, tiling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and then it runs away from the hunters of the north "
FR = "le renard brun saute par dessus le chien paresseux et puis il part loin des chasseurs du nord "
LONG = " ".join(f"word{i}" for i in range(30000))


def rows():
    out = []
    for i in range(40):
        text, lang = (EN, "en") if i % 2 else (FR, "fr")
        words = text.split()
        random.Random(i).shuffle(words)
        out.append((i, " ".join(words * 3), lang, f"s{i % 3}", 0))
    out += [(40, None, None, None, None), (41, "", "en", "s0", 0), (42, "12 34 !!", "fr", None, 8), (43, LONG, "en", "s0", 1), (None, "no id at all", "en", "s1", 1)]
    out += [(44, "same text here for all of them", "en", "s2", 1)] * 3 + [(45, "same text here for all of them", "en", "s2", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like what operators make."""
    names = ["rank", "bucket", "fp", "anchor", "c", "score", "shard", "unit", "norm", "u", "keep_id", "b", "h", "n", "length", "own_id", "hot_key_", "value", "size", "title", "p", "q", "x", "k"]
    return docs.select("*", *[F.lit("extra").alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_predictions(docs, clashing, empty):
    params = langid.LangIdParams()
    got = {r["doc_id"]: r for r in langid.identify(docs, params).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") and not got[i]["rejected"] for i in range(40))
    assert [got[i]["lang_pred"] for i in (40, 41, 42)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert collected(langid.identify(clashing, params)) == collected(langid.identify(docs, params))
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(clashing)
    assert kept.columns == clashing.columns and {40, 41, 42}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_language_learns_only_from_rows_that_are_not_held_out(docs):
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert collected(langid.identify(docs)) == collected(langid.identify(changed))


def test_language_without_labels_is_undetermined(docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_numerals_are_no_letters(spark, docs):
    odd = spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(["½", "²½ Ⅷ", "½ 12 _", "\u0301", "ª", "ñ"])], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(docs.union(odd)).collect() if (r["doc_id"] or 0) >= 1000}
    assert [got[i]["lang_pred"] for i in range(1000, 1004)] == ["und"] * 4 and all(got[i]["score"] == 0 and got[i]["rejected"] for i in range(1000, 1004))
    assert all(got[i]["lang_pred"] != "und" for i in (1004, 1005))


def test_a_language_of_many_copies_is_learned(spark):
    copies = spark.range(8000).select("id", F.lit(EN).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(8000, 11000).select("id", F.concat(F.lit(FR), F.col("id").cast("string"), F.lit(" "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("fr").alias("lang"))
    assert sorted(langid.learn(copies.union(others))) == ["en", "fr"]
    assert sorted(langid.learn(copies.union(others), langid.LangIdParams(max_languages=1))) == ["fr"]


def test_predictions_equal_brute_force(docs):
    import zstandard

    params = langid.LangIdParams()
    contents = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), params)
    assert sorted(contents) == ["en", "fr"]

    def size(lang, data):
        shared = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(params.level, write_content_size=False, write_dict_id=False, write_checksum=False)
        encoder = zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)
        return sum(len(encoder.compress(data[i : i + params.chunk_bytes])) for i in range(0, len(data), params.chunk_bytes))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(docs, params).collect():
        letters = " ".join("".join(c if c.isalpha() else " " for c in (texts[r["doc_id"]] or "").lower()).split())
        if not letters:
            assert r["lang_pred"] == "und"
            continue
        data = f" {letters} ".encode()
        (best, lang), (second, _) = sorted((size(x, data), x) for x in contents)
        assert (r["lang_pred"], r["margin_bytes"]) == (lang, second - best) and r["score"] == pytest.approx(1 - best / second)
        assert r["rejected"] == (1 - best / second < params.reject_margin)
    tie = langid.Classifier({"b": contents["en"], "a": contents["en"]}, params)
    assert tie.classify("the quick fox") == ("a", 0.0, True, 0)


def test_order_of_shards_equals_brute_force(spark, docs):
    big = docs.select("doc_id", "text", "source").union(spark.range(100, 900).select("id", F.concat(F.lit("t"), F.col("id") % 50), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold")))
    size, crc = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16, F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    stratum = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    marked = big.withColumns({"size": size, "crc": crc, "stratum": stratum}).withColumns({"u": sharding.unit_hash(F.lit(11), "doc_id", "crc", "size"), "phase": sharding.unit_hash(F.lit(12), "stratum")}).collect()
    last = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["size"])
    strata = defaultdict(list)
    for r in sorted(marked, key=lambda r: (r["u"], last(r))):
        strata[r["stratum"]].append(r)
    order = sorted(((k + r["phase"]) / len(own), name, r["u"], last(r)) for name, own in strata.items() for k, r in enumerate(own))
    n, want = len(order), []
    for pos, (*_, (has_id, doc_id, crc32, size_)) in enumerate(order):
        shard = pos * 40 // n
        want.append((doc_id if has_id else None, size_, crc32, shard, pos - -(-shard * n // 40)))
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(big).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_shards_hold_equal_counts_and_the_mixture(spark, docs, clashing, empty):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = sharding.interleave(big, 40).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == 3000 and set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(f"t{r['doc_id'] % 50}") + 16 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id'] % 50}".encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter(r["source"] for r in got)
    for s, all_of_it in total.items():
        each = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(abs(each[k] - all_of_it / 40) <= 2 for k in range(40))
    small = sharding.interleave(docs).collect()
    assert len(small) == docs.count() and {(r["size"], r["text_crc32"]) for r in small if r["doc_id"] == 40} == {(16, 0)}
    assert collected(sharding.interleave(clashing)) == collected(sharding.interleave(docs))
    assert sharding.interleave(empty).count() == 0


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fingerprint); the smallest id reachable of each."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 4:
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        first[r] = min(first.get(r, d), d, key=lambda x: (x is None, x))
    return [first[root(i)] for i in range(len(fps))]


def test_simhash_equals_brute_force(docs, clashing, empty):
    want_fp = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(want_fp, brute_components(want_fp))), key=repr)
    assert collected(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted({c for _, _, c in want}, key=repr)


def test_anchors_cover_every_close_pair():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, size=3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, size=4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for fps in (x, y):
        own = defaultdict(set)
        for a, i in zip(*(v.tolist() for v in simhash.anchors(fps))):
            own[i].add(a)
        sets.append(own)
    assert all(sets[0][i] & sets[1][i] for i in range(len(x)))
    assert max(len(v) for v in sets[0].values()) <= 32


def test_chains_and_dense_groups_are_linked(spark):
    # a chain of fingerprints, each 4 bits from the next, and a ball around another point
    chain = [sum(0xF << 4 * k for k in range(i)) for i in range(9)]
    ball = [0x123456789ABCDEF0 ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in {*chain, *ball}], "fp long")
    edges = simhash.link_fingerprints(df).collect()
    from assaykit.llm.components import components

    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["component"]].add(r["node"])
    assert sorted(map(len, got.values())) == [9, len(set(ball))]
    # a tree leaves each set, not its pairs
    assert max(Counter(r["a"] for r in edges).values()) < 200


def test_a_wider_radius_finds_the_same_components(spark):
    rng = random.Random(21)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in sorted(fps)], "fp long")
    from assaykit.llm.components import components

    narrow, wide = (collected(components(simhash.link_fingerprints(df, radius))) for radius in (2, 3))
    assert narrow == wide and len(narrow) > 100
    want = brute_components([(signed(v), v) for v in sorted(fps)])
    sets = defaultdict(set)
    for v, c in zip(sorted(fps), want):
        sets[c].add(signed(v))
    assert {n: c for n, c in narrow} == {n: min(own) for own in sets.values() if len(own) > 1 for n in own}


def test_largest_id_is_no_null(spark):
    most, text = (1 << 63) - 1, "some words that are the same in each of these rows"
    df = spark.createDataFrame([(most, text), (None, text), (None, "quite another text of which there is but one")], "doc_id long, text string")
    got = collected(simhash.near_duplicates(df).select("doc_id", "component_id"))
    assert got == sorted([(most, most), (None, most), (None, None)], key=repr)
    assert collected(simhash.keep_one_of_each(df).select("doc_id")) == sorted([(most,), (None,)], key=repr)


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(None, "equal rows " * 5, {"a": i % 2}, i % 2) for i in range(500)], "doc_id long, text string, m map<string,int>, own int")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 1


def test_components_of_odd_edges(spark):
    from assaykit.llm.components import components

    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = [(i, i + 1) for i in range(60)] + [(5, 5), (7, 6), (7, 6), (100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_licences(spark, empty):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licenced to thrill under the moon and stars", "This work is licensed under the GNU General Public License, version 3."]
    full = next(t for name, t in licenses.TEMPLATES if name == "BSD-2-Clause")
    data = [(1, "Some prose of quite another kind, and at length.\n" + lines[0]), (2, lines[1] + "\nand more of the same kind of prose here\n" + lines[1]), (3, lines[2]), (4, None), (5, ""), (6, "\n".join(textwrap.wrap(full, 60))), (7, "word"), (8, LONG + "\n" + lines[3]), (1, "Some prose of quite another kind, and at length.\n" + lines[0])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("norm", F.lit(1)).withColumn("license", F.lit(2))
    got = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in licenses.scan(df).collect()}
    assert got[1, "MIT"] == (1.0, 1) and got[2, "CC-BY-NC-4.0"] == (1.0, 1) and got[8, "GPL-3.0"] == (1.0, 1)
    assert (6, "BSD-2-Clause") in got and {d for d, _ in got} == {1, 2, 6, 8}
    assert licenses.scan(empty).count() == 0


def test_notices_among_other_words(spark):
    prose = "The river bends here and the old mill stands on its northern bank."
    gpl = [x for x in licenses.TEMPLATES if x[0] == "GPL-3.0"][-1][1]
    gpl = gpl.replace(" This program is distributed", "\n\nThis program is distributed").replace(" See the GNU", "\n\nSee the GNU")
    affero = next(t for name, t in licenses.NOTICES if name == "AGPL-3.0" and len(t) > 60)
    data = [
        (1, "Copyright (c) 2020 Jane Doe. Released under the MIT License."),
        (2, f"{prose} Licensed under CC BY-NC 4.0. {prose}"),
        (3, f"{LONG}\n\n{gpl}\n\n{prose}"),
        (4, "\n".join(textwrap.wrap(f"{prose} {affero} {prose}", 60))),
        (5, f"Released under the MIT License.\n{prose} Licensed under the MIT License. {prose}\n{prose}"),
        (6, f"{prose} The licence of this mill is on the wall."),
        (None, f"{prose} Released under the MIT License."),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT"): (1.0, 1), (2, "CC-BY-NC-4.0"): (1.0, 1), (3, "GPL-3.0"): (1.0, 1), (4, "AGPL-3.0"): (1.0, 1), (5, "MIT"): (1.0, 2), (None, "MIT"): (1.0, 1)}


def test_licence_pruning_loses_nothing(spark):
    rng = random.Random(2)
    data = []
    for i in range(120):
        name, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randint(0, max(1, len(words) // 8))):
            words[rng.randrange(len(words))] = rng.choice(["alpha", "beta", "the"])
        data.append((i, " ".join(words)))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = set()
    for i, text in data:
        a = set(licenses.template_bigrams(text))
        best = max(((2 * len(a & set(t)) / (len(a) + len(t)), name) for name, tt in licenses.TEMPLATES for t in [licenses.template_bigrams(tt)]), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= licenses.THRESHOLD:
            want.add((i, best[1]))
    assert got == want


def brute_tiles(item, text, least):
    """Greedy string tiling as defined: the longest unmarked common runs, again and again."""
    a, b, marked_a, marked_b, covered = item, text, set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        marked_a |= set(range(i, i + n))
        marked_b |= set(range(j, j + n))
        covered += n


def test_tiling_equals_brute_force():
    rng = random.Random(9)
    p = tiling.TilingParams(min_match=3, min_coverage=0.01)
    for _ in range(150):
        item = [rng.choice("abcdef") * 2 for _ in range(rng.randint(3, 25))]
        text = [rng.choice("abcdef") * 2 for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            k = len(item) // 2
            text += item[k:] + ["zz"] + item[:k]
        got = tiling.Index([(1, " ".join(item))], p).leaks(" ".join(text))
        want = brute_tiles(item, text, 3)
        assert (got[0][1] if got else 0) == pytest.approx(round(want / len(item), 6), abs=1e-6)


def test_leaks_and_reordered_passages(spark, docs, clashing, empty):
    passage = " ".join(f"item{i}" for i in range(40))
    half = passage.split()
    moved = " ".join(half[20:] + ["filler"] * 5 + half[:20])
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "tiny one"), (1, passage)], "item_id long, text string")
    data = [(1, "start " + passage.upper() + " end"), (2, moved), (3, " ".join(half[:12])), (4, None), (5, LONG), (6, "a tiny one here")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("x", F.lit(0))
    got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.leaks(df, bench).collect())
    assert got == [(1, 1, 1.0)] * 2 + [(2, 1, 1.0)] * 2 + [(6, 4, 1.0)]
    assert sorted(r["doc_id"] for r in tiling.keep_clean(df, bench).collect()) == [3, 4, 5]
    assert tiling.keep_clean(clashing, bench).columns == clashing.columns
    assert tiling.leaks(empty, bench).count() == 0 and tiling.leaks(docs, bench.limit(0)).count() == 0
    in_blocks = tiling.leaks(df, bench, tiling.TilingParams(block_bytes=10))
    assert collected(in_blocks) == collected(tiling.leaks(df, bench))


def test_leaks_of_repetitive_texts_and_many_blocks(spark, docs):
    import tracemalloc

    index = tiling.Index([(1, "a " * 200), (2, "a " * 100 + " ".join(map(str, range(100))))], tiling.TilingParams())
    tracemalloc.start()
    assert index.leaks("a " * 300_000) == [(1, 1.0, 1, 200, 200), (2, 0.5, 1, 100, 200)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    bench = spark.createDataFrame([(i, f"{EN} item {i}" if i % 3 else f"nobody ever wrote this sentence number {i} here") for i in range(20)] + [(None, EN), (7, None), (3, f"{EN} item {3}")], "item_id long, text string")
    one, many = tiling.TilingParams(), tiling.TilingParams(block_bytes=300)
    texts = docs.union(spark.createDataFrame([(900, EN * 2, "en", "s", 0)], DOCS))
    assert len(list(tiling.blocks(bench, many))) > 4
    assert collected(tiling.leaks(texts, bench, one)) == collected(tiling.leaks(texts, bench, many)) != []
    assert collected(tiling.keep_clean(texts, bench, one)) == collected(tiling.keep_clean(texts, bench, many))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts_equal_brute_force(docs, clashing, empty):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bb", "é", " ", "\n", "\t", "#", "\x0b", " ", "c d e "]) for _ in range(rng.randint(0, 60)))
        assert bands.counts(text) == brute_counts(text)
    got = {r["doc_id"]: r for r in bands.quality(docs).collect()}
    assert got[40]["n_words"] == 0 and got[40]["base_failed"] and not got[40]["kept"]
    assert got[43]["n_words"] == 30000
    assert collected(bands.quality(clashing)) == collected(bands.quality(docs)) and bands.quality(empty).count() == 0


def test_bands_reject_repetition_and_noise():
    import zstandard

    enc, limits = zstandard.ZstdCompressor(level=3, write_content_size=False), bands.BandLimits()
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000)) + "".join(rng.choice("0123456789abcdefABCDEFGHIJKLMNOPqrstuvwxyz+/") for _ in range(40))
    assert bands.verdict(prose, enc, limits)[2] is None and bands.verdict(prose[:300], enc, limits)[2] is None
    assert bands.verdict("buy now " * 2000, enc, limits)[2] == "whole repetitive"
    assert bands.verdict(bytes(rng.randrange(33, 127) for _ in range(9000)).decode() , enc, bands.BandLimits(chunk=(1.3, 8.0)))[2] is not None
    half = prose[:9000] + "again and " * 1500
    assert bands.verdict(half, enc, limits)[2] is not None
    assert noise and bands.verdict("", enc, limits) == (None, None, None)


def test_verdicts_equal_brute_force(docs):
    import zstandard

    limits = bands.BandLimits()

    def ratio(data):
        return len(data) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))

    def out(data, low, high):
        return (ratio(data) < low) + 2 * (ratio(data) > high)

    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(400))
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2500))
    texts = [r["text"] or "" for r in docs.collect()] + [noise, prose, prose[:5000] + noise[:3000], prose[:4096] + noise[:9000], prose[:3900] + "spam " * 900, noise[:12_000] + "spam " * 1600, "spam " * 2000, prose[:300], noise[:300]]
    encoder = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
    reasons = Counter()
    for t in texts:
        data = t.encode()
        whole = out(data, *next((lo, hi) for n, lo, hi in reversed(limits.whole) if n <= len(data))) if data else 0
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
        verdicts = [(len(x), out(x, *limits.chunk) if len(x) == 4096 else out(x, *next((lo, hi) for n, lo, hi in reversed(limits.whole) if n <= len(x)))) for x in parts]
        bad = sum(n for n, v in verdicts if v)
        _, share, reason = bands.verdict(t, encoder, limits)
        assert share == (bad / len(data) if parts else None)
        assert (reason is not None) == bool(whole or bad > 0.5 * len(data))
        reasons[reason] += 1
    assert {"whole repetitive", "whole incompressible", "chunks incompressible", None} <= set(reasons), reasons


def test_bands_reject_encoded_data_and_repeated_sentences_of_every_length(spark):
    import base64

    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    sentences = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(8)]
    texts, reasons = [], []
    for n in (3700, 12_000, 24_000, 91_000):
        code = base64.b64encode(rng.randbytes(n)).decode()[:n]
        code = " ".join(code[i : i + 60] for i in range(0, n, 60))
        fresh = " ".join(rng.choice(words) for _ in range(n // 6))
        # every sentence comes several times, among new words
        again = " ".join(rng.choice(sentences) + " " + " ".join(rng.choice(words) for _ in range(3)) for _ in range(n // 90))
        texts += [code, fresh, again]
        reasons += ["whole incompressible", None, "whole repetitive"]
    texts.append(fresh[:70_000] + " " + code)
    reasons.append("chunks incompressible")
    got = sorted(bands.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["reason"] for r in got] == reasons and [r["kept"] for r in got] == [x is None for x in reasons]


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(text):
    out = {}
    for kind, rx in BASE.items():
        out[kind] = []
        for m in rx.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "_", "-", "+", " ", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "1.2.3.4.5.6.7.8", "x@y.zz", "+1 (555) 010-9999", "(", ")", "é", "\n", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_personal_data(spark, clashing, empty):
    iban, bad = "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01"
    text = f"Mail a.b@c.org, call +49 30 901820-0, card 4111 1111 1111 1111, host 10.1.2.3; IBAN {iban} not {bad}; ssn 078-05-1120"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "9" * 50000), (5, "a" * 50000 + "@"), (6, "+" + "(" * 50000)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert [got[1][f"n_{k}"] for k in pii.BASE_KINDS] == [1, 1, 1, 1]
    own = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in brute_base(text)[k])
    assert got[1]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and got[1]["spans"].startswith(own)
    assert f"iban:{text.index(iban)}:{text.index(iban) + len(iban)}" in got[1]["spans"] and got[1]["spans"].count("iban") == 1 and "national_id" in got[1]["spans"]
    assert all(got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in (2, 3, 4, 5, 6))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[2] is None and "[EMAIL]" in clean[1] and "[IBAN]" in clean[1] and "4111" not in clean[1] and bad in clean[1]
    again = pii.redacted(clashing)
    assert again.columns == clashing.columns and pii.personal_data(empty).count() == 0
    assert {r["n_chars"] for r in again.filter("doc_id = 41").collect()} == {0}


def test_ibans_of_the_whole_registry():
    # the registry's own examples
    ibans = "SK3112000000198742637541 MT84MALT011000012345MTLCAST001S BG80BNBG96611020345678 HR1210010051863000160 CY17002001280000001200527600 EE382200221020145685 LV80BANK0000435195001 LT121000011101001000 SI56263300012039086 IS140159260076545510730339 LI21088100002324013AA MC5811222000010123456789030 TR330006100519786457841326 SA0380000000608010167519 AE070331234567890123456 IL620108000000099999999 BR1800360305000010009795493C1 LC55HEMM000100010012001200023015".split()
    for iban in ibans:
        for written in (iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))):
            text = f"Please pay to {written} AND SOON."
            assert [(k, text[a:b]) for k, a, b, _ in pii.find(text)[1]] == [("iban", written)]
            assert pii.redact(text) == "Please pay to [IBAN] AND SOON."
        wrong = iban[:2] + f"{(int(iban[2:4]) + 1) % 100:02}" + iban[4:]
        assert not [k for k, *_ in pii.find(f"Please pay to {wrong} AND SOON.")[1] if k == "iban"]


def test_further_kinds_equal_a_plain_search():
    """Short cards and national ids: every place is tried, with Luhn by digits and context words by hand."""
    rng = random.Random(17)
    pieces = ["card ", "amex: ", "ssn ", "example ", "security ", "378282246310005", "3782 822463 10005", "378282246310006", "4222222222222", "078-05-1120", "078-05-112", "1-078-05-1120", " and ", "\n", "x", "5555-5555"]

    def plain_luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7)))
        base, extra = pii.find(t)
        taken = [x for v in base.values() for x in v]
        want = []
        for kind in ("card_short", "national_id"):
            at = 0
            while at < len(t):
                rx = r"[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])" if kind == "card_short" else r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
                m = re.compile(rx).match(t, at) if not re.match(r"[0-9]" if kind == "card_short" else r"[0-9-]", t[at - 1 : at] if at else "") else None
                if not m:
                    at += 1
                    continue
                a, b = m.span()
                at = b
                near = re.findall("[a-z]+", t[max(0, a - 48) : a].lower() + " " + t[b : b + 24].lower())
                hit = any(w == "card" or w.startswith("amex") for w in near) if kind == "card_short" else any(w == "ssn" or w.startswith("security") for w in near)
                s = 0.4 + 0.25 * hit - 0.25 * ("example" in near)
                if (kind == "national_id" or plain_luhn(re.sub("[^0-9]", "", m[0]))) and s >= 0.6 and not any(x < b and a < y for x, y in taken):
                    want.append((kind, a, b))
                    taken.append((a, b))
        assert [x[:3] for x in extra] == want, t
