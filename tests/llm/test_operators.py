"""Every operator on odd and empty tables, and against brute force on small ones."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spanforge.llm import chat, cotraining, fingerprint, graph, linededup, mixing, ngramjoin, packing, records, secrets, tokens, vafile
from spanforge.llm.common import hash_filter, may_hold, new_folder, range_bounds, range_index, save

from .conftest import LONG, PROSE


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- common -----------------------------------------------------------------


def test_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    bounds = range_bounds(df, "x", 10)
    found = df.unionByName(spark.createDataFrame([(None,)], "x long")).select("x", range_index(F.col("x"), bounds).alias("b")).collect()
    assert all(r["b"] == (len(bounds) if r["x"] is None else sum(b <= r["x"] for b in bounds)) for r in found)


def test_hash_filter_loses_nothing(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    own = df.where("id % 50 = 0")
    bits = hash_filter(own, "h")
    hit = may_hold(df, "h", bits)
    assert own.exceptAll(hit).isEmpty() and hit.count() < 200
    assert hit.count() + may_hold(df, "h", bits, inverse=True).count() == 5000


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 3), (20, 21), (5, 5)] + [(i, i + 1) for i in range(100, 130)]
    found = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20} | dict.fromkeys(range(100, 131), 100)
    assert rows(graph.connected_components(spark.createDataFrame([], "a long, b long"))) == []


# -- 1: mixing --------------------------------------------------------------


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def test_mix_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 900, None: 40}, {"x": 7}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1, "d": 10_000}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        assert found == pytest.approx(expected_targets(sizes))


def test_mix_meets_targets(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(5)).cast("string")).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") * 37 % 80).cast("int") + 1), " ").alias("text"),
    )
    found = mixing.mix(docs)
    again = {(r["doc_id"], r["n"]) for r in found.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert again == {(r["doc_id"], r["n"]) for r in mixing.mix(docs.repartition(7)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    for source, target in expected_targets(sizes).items():
        assert abs(taken[source] - target) <= 5
    assert max(n for _, n in again) <= 3


def test_mix_odd(odd, none):
    found = mixing.mix(odd)
    assert found.columns == odd.columns and found.exceptAll(odd.unionAll(odd).unionAll(odd)).isEmpty()
    assert mixing.mix(none).isEmpty()


# -- 2: fingerprints --------------------------------------------------------


def fingerprints(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["f"] for r in df.select("i", fingerprint.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_fingerprint_is_a_multiset_hash(spark):
    a, b, c, d, e, f, g = fingerprints(spark, "x y\nlonger line here\nz", "z\nx y\nlonger line here", "z\nx y", "longer line here", "z\nz\nx y", None, "")
    assert a == b and a != c and c != e and f == g
    df = spark.createDataFrame([(a, c, d)], "a string, c string, d string")
    found = df.select(fingerprint.insert(F.col("c"), F.col("d")).alias("i"), fingerprint.delete(F.col("a"), F.col("d")).alias("d")).first()
    assert found["i"] == a and found["d"] == c


def test_fingerprint_likeness(spark):
    line = lambda i: " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[: 4 + j] for j in range(12))
    texts = ["\n".join(map(line, range(200))), "\n".join(map(line, range(50, 250))), "\n".join(map(line, range(1000, 1200)))]
    a, b, c = fingerprints(spark, *texts)
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    same, near, far = df.select(*[fingerprint.likeness(F.col("a"), F.col(x)).alias(x) for x in "abc"]).first()
    assert same == 1 and 0.35 < near < 0.85 and 0 <= far < 0.3


def test_next_documents(spark, odd, none):
    docs = spark.createDataFrame([(i * 3, f"text {i}") for i in range(200)], "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(docs).collect()}
    assert found == {i * 3: f"text {(i + 1) % 200}" for i in range(200)}
    sole = fingerprint.with_next(docs.where("doc_id = 3")).collect()
    assert [(r["doc_id"], r["next_text"]) for r in sole] == [(3, "text 1")]
    assert fingerprint.with_next(odd).count() == odd.count()
    assert fingerprint.with_next(none).isEmpty()


# -- 3: co-training ---------------------------------------------------------


def test_cotraining_learns(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(PROSE.split(), 40)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(PROSE.split(), 40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 450, 3)] + [(0, None), (None, 1)], "doc_id long, label int")
    found = cotraining.feature_table(docs)
    model = cotraining.fit(found, labels)
    scored = {r["doc_id"]: r["score"] for r in cotraining.score_features(found, model).collect()}
    assert np.mean([(scored[i] >= 0.5) == (i < 300) for i in range(450) if i % 3]) > 0.97
    whole = {r["doc_id"]: r["_quality_score"] for r in cotraining.score_documents(docs, model).collect()}
    assert whole == pytest.approx(scored, abs=0.02)


def test_cotraining_odd(spark, odd, none):
    one = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, label int")
    found = cotraining.feature_table(odd)
    assert {r["score"] for r in cotraining.score_features(found, cotraining.fit(found, one)).collect()} == {1.0}
    two = spark.createDataFrame([(1, 1), (5, 0), (4, 0), (9, 1)], "doc_id long, label int")
    scored = cotraining.score_documents(odd, cotraining.fit(found, two))
    assert scored.columns == [*odd.columns, "_quality_score"] and scored.count() == odd.count()
    empty = cotraining.feature_table(none)
    assert cotraining.score_documents(none, cotraining.fit(empty, two)).isEmpty()


# -- 4: secrets -------------------------------------------------------------


def test_secrets(spark, odd, none):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'and then token = "{key}" of the', f"see commit {key} for more", "thethertionandthenand of the words", 'api_key = "your-token-goes-here-xxxx"', f'token = "{key}"', None, ""]
    docs = spark.createDataFrame([(i, t, None if i == 4 else "src/a.py") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    found = secrets.scan(docs, secrets.labelled_findings(spark, 1600)).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 4]
    assert all(r["digest"] == hashlib.sha256(key.encode()).hexdigest() and key not in str(r) for r in found)
    odd_docs = odd.withColumn("path", F.col("source"))
    assert secrets.scan(odd_docs, secrets.labelled_findings(spark, 1600)).count() == 0
    assert secrets.scan(none.withColumn("path", F.col("source")), secrets.labelled_findings(spark, 1600)).isEmpty()


def test_forest_on_held_out_findings(spark):
    every = secrets.labelled_findings(spark, 3200)
    parts = ["the", "and", "ing"]
    model = secrets.train(every.limit(1600), parts)
    rest = secrets.scored(every.exceptAll(every.limit(1600)), model, parts)
    hit = rest.select(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int").alias("hit")).agg(F.avg("hit")).first()[0]
    assert hit > 0.97


# -- 5, 9: tokens -----------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        own = _tokenizer
    except NameError:
        own = _tokenizer = Tokenizer.from_file(tokens.default_path())
    return own.encode(text or "", add_special_tokens=False).ids


TRICKY = ["it's  don't 'S 'll", "a\tb\r\nc\x0bd\x0ce\x85f g", "Ünïcödé ﬁ ½ ² ³x ª·", "é É", "İstanbul ΣΑΣ ß", "<|endoftext|>x<|startoftext|>", "!!?? a,b.c; (d)", "1234 5a6", "日本語 text", "x\x1cy ​", "'", "<", "", "\n\n", "𝒳 😀!"]


@pytest.mark.parametrize("text", [*TRICKY, LONG[:2000]])
def test_word_encoder_is_the_tokenizer(text):
    enc = tokens.WordEncoder(tokens.default_path(), most_words=3)
    for _ in range(2):
        assert enc.ids(text).tolist() == plain_ids(text)


def test_records_round_trip(spark, odd, none):
    folder = new_folder(spark, "records-test")
    manifest = records.write_records(odd, folder, tokens.default_path(), 2, 3)
    found = sorted(rows(records.read_records(manifest)), key=lambda r: r[1])
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()), key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or ""))
    at = 0
    for (doc_id, start, n, crc), (want, text) in zip(found, texts, strict=True):
        ids = np.array([*plain_ids(text), 2], "<u4")
        assert (doc_id, start, n, crc) == (want, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    file = manifest.orderBy("part").first()["file"]
    assert records.read_record(file, 0)[0] == texts[0][0]
    assert rows(records.read_records(records.write_records(none, new_folder(spark, "none"), tokens.default_path(), 2, 2))) == []


def test_damaged_records_are_found():
    import io

    whole = records.frame(records.pack(5, b"\x01\x00\x02\x00", 2))
    doc_id, ids = records.unpack(records.read_frame(io.BytesIO(whole)))
    assert doc_id == 5 and ids.tolist() == [1, 2]
    for i in range(len(whole)):
        broken = whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(broken))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(whole[:-1]))


def check_packed(found, texts, window):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, pieces in by_doc.items():
        ids = np.array([*plain_ids(texts[doc_id]), 2], "<u4")
        covered = []
        for r in pieces:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            covered += range(r["start"], r["start"] + r["length"])
        assert sorted(set(covered)) == list(range(len(ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_packing(spark, odd, none):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    found = packing.pack_documents(odd, window=512).collect()
    check_packed(found, texts, 512)
    assert packing.pack_documents(none).isEmpty()
    rng = np.random.default_rng(2)
    texts = {i: " ".join(rng.choice(PROSE.split(), n)) for i, n in enumerate(rng.integers(1, 400, 400))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = packing.pack_documents(docs, window=512).collect()
    n = check_packed(found, texts, 512)
    assert n <= 1.04 * sum(r["length"] for r in found) / 512 + 1


def test_least_squares():
    rng = np.random.default_rng(3)
    a = rng.random((12, 30))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=30), 0))
    assert (x >= 0).all()
    gradient = a.T @ (a @ x - a @ x)
    assert np.abs(gradient).max() < 1e-9
    histogram = np.zeros(16, dtype=np.int64)
    histogram[[7, 3, 11]] = [100, 40, 40]
    used = packing.repeat_counts(histogram, 16)
    taken = Counter()
    for c, n in used:
        assert 15 <= sum(k * m for k, m in c.items()) <= 16
        for k, m in c.items():
            taken[k] += n * m
    assert all(v <= histogram[k - 1] for k, v in taken.items()) and sum(taken.values()) >= 175


# -- 6: lines ---------------------------------------------------------------


WORDS = regex.compile(r"[\p{L}\p{N}]+")


def word_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def brute_lines(docs, similarity=0.8):
    """The texts that stay, by comparing the words of all lines."""
    texts = {r["doc_id"]: (r["text"] or "").split("\n") for r in docs.collect()}
    places = defaultdict(list)
    for d, lines in sorted(texts.items()):
        for i, line in enumerate(lines):
            if own := tuple(WORDS.findall(line.lower())):
                places[own].append((d, i))
    root = {k: k for k in places}
    for a, b in itertools.combinations(places, 2):
        n = max(len(a), len(b))
        if min(len(a), len(b)) >= linededup.least_words(similarity) and abs(len(a) - len(b)) <= (1 - similarity) * n and word_distance(a, b) <= (1 - similarity) * n + 1e-9:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
    gone = set()
    for group in set(root.values()):
        found = sorted(p for k in places if root[k] == group for p in places[k])
        gone |= set(found[1:])
    return {d: "\n".join(x for i, x in enumerate(t) if (d, i) not in gone) for d, t in texts.items()}


def test_lines_against_brute_force(spark):
    """Groups of near copies, chains (each line near the next only), a passage that many different lines share, repeated lines."""
    rng = np.random.default_rng(4)
    base = [rng.choice(1000, 60) for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(20))
    chain = [f"c{i}" for i in range(20)]
    docs = []
    for i in range(90):
        lines = []
        for _ in range(3):
            own = base[rng.integers(12)].copy()
            for _ in range(rng.integers(9)):
                own[rng.integers(60)] = rng.integers(1000)
            lines.append(" ".join(f"W{w}" for w in own))
        chain[rng.integers(20)] = f"d{i}"
        around = [f"v{x}" for x in rng.integers(500, size=20)]
        lines += [" ".join(chain), " ".join([*around[:10], passage, *around[10:]])]
        docs.append((i, "\n".join([*lines, "", "same short line"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert found == brute_lines(df)
    assert sum(t.count("W") > 0 for t in found.values()) < 80 and sum(passage in t for t in found.values()) == 90


def test_lines_odd(odd, none):
    found = linededup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "_line_count", "_line_gone"] and found.count() == odd.count()
    texts = Counter((r["doc_id"], r["text"]) for r in found.collect())
    assert texts[(3, None)] == 1 and texts[(4, "")] == 1 and texts[(6, "a\n\nb c")] == 1 and texts[(7, "")] == 2 and texts[(1, PROSE + " " + PROSE)] == 1
    assert {r["doc_id"] for r in linededup.dedup_lines(odd, drop_empty=True).collect()} == {1, 3, 4, 5, 6, 8, 9, 10, None} | ({2} if texts[(2, "")] == 0 else set())
    assert linededup.dedup_lines(none).isEmpty()


# -- 7: chat ----------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["plain", "<|turn|>", "a<\\|end|>b", "<\\\\|", "<", "|x|", None, "", "\\### Assistant: </turn> ok", "<|text|>assistant<|end|>"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, None, "user", "y"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    out = out.select("conv_id", "n_turns", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    found = {r["conv_id"]: r for r in out.collect()}
    assert [t["text"] for t in found[1]["back"]] == [t or "" for t in texts]
    assert found[1]["under"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [(t["role"], t["text"]) for t in found[2]["back"]] == [("", "x")] and found[None]["n_turns"] == 1
    assert [t["text"] for t in found[3]["back"]] == ["a", "a", "b"]


def test_chat_attachments(spark):
    part = "struct<type:string,text:string,ref:string,units:int>"
    data = [
        (1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", 10)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None), ("video", "kept as text", None, None)]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|turn|>user<|text|>see <\\|<|image 1|> and <|audio 2|><|end|><|turn|>assistant<|text|><|document 3|>kept as text<|end|><|turn|>user<|text|><|end|>"
    assert [(a["type"], a["ref"], a["ordinal"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 1, 512), ("audio", "b.wav", 2, 250), ("document", "c.pdf", 3, 800)]
    assert r["expanded_tokens"] == 1562
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == ["<|document 3|>kept as text"]
    assert chat.format_chats(df.limit(0)).isEmpty()


# -- 8: n-grams -------------------------------------------------------------


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(docs, threshold=0.8):
    classes = defaultdict(list)
    for doc_id, text in docs:
        classes[grams(text)].append(doc_id)
    sets = [s for s in classes if s]
    links, root = Counter(), {s: min(classes[s]) for s in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {s: low if r == high else r for s, r in root.items()}
    found = {i: (root[s], min(classes[s]), links[s], len(classes[s])) for s in sets for i in classes[s]}
    return found | {i: (i, i, 0, 1) for i in classes.get(frozenset(), [])}


def test_join_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.choice(3000, 150) for _ in range(6)]
    docs = []
    for i in range(150):
        own = base[rng.integers(6)].copy()
        for _ in range(rng.integers(4)):
            own[rng.integers(150)] = rng.integers(3000)
        docs.append((i, " ".join(f"w{x}" for x in own)))
    docs += [(200, None), (201, ""), (202, "two words"), (203, "Two, words!"), (204, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_join(docs)
    for tile, chars in ((4096, 2_000_000), (20, 20_000)):  # the second deals buckets and clusters out as tiles
        monkeypatch.setattr(ngramjoin, "TILE", tile)
        monkeypatch.setattr(ngramjoin, "TILE_CHARS", chars)
        found = {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"], r["n_copies"]) for r in ngramjoin.join(df).collect()}
        assert found == want
    assert len({v[0] for v in want.values()}) < 40 and max(v[2] for v in want.values()) > 5
    kept = {r["doc_id"] for r in ngramjoin.one_of_each(df).collect()}
    assert kept == {v[0] for v in want.values()}


def test_join_odd(odd, none):
    found = ngramjoin.join(odd)
    assert found.count() == odd.count()
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["class_id"] == by_id[7]["class_id"] == 1 and by_id[3]["n_links"] == 0
    kept = ngramjoin.one_of_each(odd)
    assert kept.columns == odd.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert ngramjoin.join(none).isEmpty() and ngramjoin.one_of_each(none).isEmpty()


def test_posterior_bound():
    least = ngramjoin.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * ngramjoin.HASHES
    n, m, t = ngramjoin.HASHES, int(least[-1]), 0.8
    beta = lambda m: sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
    assert beta(m) >= 1e-6 > beta(m - 1)


# -- 10: vectors ------------------------------------------------------------


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(700, 12)) * 20)
    x[5] = x[6] = x[7]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [1.0]), (1004, []), (1005, [float("inf")] * 12)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    for blocks in ((8192, 512), (64, 3)):
        monkeypatch.setattr(vafile, "ROWS", blocks[0])
        monkeypatch.setattr(vafile, "QUERIES", blocks[1])
        found = defaultdict(list)
        for r in vafile.search(df, F.col("id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert sorted(found) == list(range(0, 700, 50))
        for q, got in found.items():
            s = x @ x[q]
            want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
            assert got == [(i, s[i]) for i in want]
    assert vafile.search(df.limit(0), F.col("id") % 50 == 0, 5).isEmpty()
    few = {r["rank"] for r in vafile.search(df.limit(3), F.col("id") == 0, 5).collect()}
    assert few == {1, 2}


# -- saving -----------------------------------------------------------------


def test_saved_tables_keep_their_schema(spark, none):
    assert save(none, "none").schema.simpleString() == none.schema.simpleString()
