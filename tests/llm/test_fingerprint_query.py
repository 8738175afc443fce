"""Operator 2: likeness in any script and at any length, and the query against hashlib."""

import hashlib
import random

from pyspark.sql import functions as F

from spanforge.llm import fingerprint


def pieces(kind: str, n: int, seed: int) -> list[str]:
    """Words or characters, each with the blank or line end behind it."""
    r = random.Random(seed)
    if kind == "words":
        return ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) + ("\n" if i % 20 == 19 else " ") for i in range(n)]
    if kind == "one paragraph":
        return [x.replace("\n", " ") for x in pieces("words", n, seed)]
    if kind == "short lines":
        return [x.strip() + ("\n" if i % 3 == 2 else " ") for i, x in enumerate(pieces("words", n, seed))]
    if kind == "ideographs":
        return [chr(r.randint(0x4E00, 0x9F00)) for _ in range(n)]
    if kind == "no blanks":
        return [r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)]
    return [chr(r.choice([*range(0x430, 0x450), 32, 32, 32])) for _ in range(n)]


def test_likeness_of_scripts_and_lengths(spark):
    rows = []
    for kind, n in [("words", 60), ("words", 600), ("words", 110_000), ("one paragraph", 900), ("short lines", 600), ("ideographs", 4000), ("no blanks", 8000), ("cyrillic", 4000)]:
        a, b = pieces(kind, n, 1), pieces(kind, n, 2)
        edited = a[: n - n // 4] + b[: n // 4]
        rows.append((f"{kind} {n}", "".join(a), "".join(edited), "".join(b)))
    chunks = {x: F.filter(F.flatten(F.transform(fingerprint.paragraphs(F.col(x)), fingerprint.chunked)), lambda c: c != "") for x in "abc"}
    df = spark.createDataFrame(rows, "kind string, a string, b string, c string").repartition(8)
    df = df.select("kind", *(fingerprint.fingerprint(F.col(x)).alias(f"f{x}") for x in "abc"), *(chunks[x].alias(f"c{x}") for x in "abc")).cache()
    near, far = (fingerprint.likeness(F.col("fa"), F.col(x)) for x in ("fb", "fc"))
    df = df.select("kind", near.alias("near"), far.alias("far"), "ca", "cb", "cc")
    for row in df.collect():
        a, b, c = (set(row[f"c{x}"]) for x in "abc")
        assert abs(row["near"] - len(a & b) / len(a | b)) < 0.15, row["kind"]
        assert abs(row["far"] - len(a & c) / len(a | c)) < 0.15, row["kind"]
        # A quarter of the text is another's: near 0.6, give or take what is at the seam.
        assert 0.4 < row["near"] < 0.8, (row["kind"], row["near"])


def test_query_equals_hashlib(spark, tmp_path):
    texts = [None, "", "abcdefg", "ünïcode 😀 text of some words\nsecond line", "x" * 9, "the same", "the same", "last one here"]
    rows = [(3 * i + 1, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in fingerprint.op2_fingerprint(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, (doc_id, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = found[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_next"] == 1.0 if text == after else row["near_next"] < 1
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (text == edited)
    assert found[16]["fingerprint"] == found[19]["fingerprint"]


def test_equal_lanes_are_sums_of_digest_words(spark):
    text = "one\ntwo\ntwo"
    fp = spark.createDataFrame([(text,)], "t string").select(fingerprint.fingerprint(F.col("t"))).first()[0]
    digests = [hashlib.sha256(p.encode()).digest() for p in text.split("\n")]
    lanes = [sum(int.from_bytes(d[4 * i : 4 * i + 4], "big") for d in digests) % (1 << 32) for i in range(fingerprint.EQUAL)]
    assert [int(fp[16 + 8 * i : 24 + 8 * i], 16) for i in range(fingerprint.EQUAL)] == lanes
