"""Operator 4 scores every run of a word."""

import hashlib

from spanforge.llm import secrets


def test_all_keys_of_a_word(spark):
    one, two = (hashlib.sha1(x).hexdigest() for x in (b"1", b"2"))
    akia = "AKIA" + hashlib.sha256(b"3").hexdigest()[:16].upper()
    texts = [f'{{"id":"{one}","token":"{two}"}}', f"https://h.com/long/path/segments?token={akia}", f"client_secret_access_key={two}", f"{one},{one}"]
    docs = spark.createDataFrame([(i, t, "src/a.py") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    every = [(r["doc_id"], r["run"], r["core"]) for r in secrets.candidates(docs).collect()]
    want = [(0, 0, one), (0, 1, two), (1, 0, "com/long/path/segments"), (1, 1, akia), (2, 0, "client_secret_access_key="), (2, 1, two), (3, 0, one), (3, 1, one)]
    assert sorted(every) == want
    found = {(r["doc_id"], r["digest"]) for r in secrets.scan(docs, secrets.labelled_findings(spark, 1600)).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(0, digest(two)), (1, digest(akia)), (2, digest(two))} <= found
    assert (1, digest("com/long/path/segments")) not in found
