"""Document fingerprints by a homomorphic multiset hash (DataFrame functions only).

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors modulo powers of two. So it does not depend on their
order, and a paragraph can be added to or taken from it without the rest
(``insert``, ``delete``). The vector has three runs of lanes:

* the count of paragraphs, and the count of chunks, modulo 2**32;
* EQUAL lanes modulo 2**32, the words of the paragraph's SHA-256: two documents
  agree in all only if they have equal paragraphs;
* LEVELS x LANES lanes modulo 2**8 for likeness. A paragraph is cut into chunks
  of a few words, or characters where there are no blanks, at places that only the
  text around them decides, in any script; the hash of a chunk is added to one lane
  of level 0, and to one of level 1, 2, ... if its hash ends in that many times THIN
  zero bits. The thinnest level tells texts of some ten million chunks apart.

Likeness of two fingerprints: the share of lanes of a level in which they agree
tells how many chunks are in one and not in the other (a lane is hit by a chunk
with probability 1 / LANES); the lowest level in which enough agree counts (if it is
not level 0, the next one too), and the difference in their numbers is the least. With
the numbers of chunks that gives a Jaccard similarity, from 0 to 1.

Cases: a null text is empty; an empty text has one empty paragraph, which counts;
equal texts have equal fingerprints; rows of equal id are ordered by text, and the
last one's next is the first row with another id's; null ids come last; the last
document's next is the first; a sole document is its own next; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, range_bounds, range_index, table

EQUAL, LANES, LEVELS, THIN = 8, 128, 9, 2
#: The least share of agreeing lanes from which a level's estimate is taken.
ENOUGH = 0.12
#: Ends of chunks in UTF-8 bytes, a character each: white space behind one of LAST; behind a character beyond ASCII
#: whose last three bits are zero; in runs of ASCII without blanks, behind one of IN_RUN.
LAST, BEYOND, IN_RUN = r"dgnorxyDGNORXY02468.,;:!?|%", r"\x80\x88\x90\x98\xA0\xA8\xB0\xB8", "dnxGQ7"
CHUNK_END = rf"(?<=[{LAST}{BEYOND}{IN_RUN}])(?:(?<=[{LAST}])\s+|(?<=[{BEYOND}])(?![\x80-\xBF])|(?<=[{IN_RUN}])(?<=[\x21-\x7E]{{24}}))"
WORD, BYTE = 0xFFFFFFFF, 0xFF
BUCKETS_PER_PARTITION = 8


def _sum(values: Column, mask: int) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate(values, zero, lambda a, x: a + x, lambda a: a.bitwiseAND(F.lit(mask).cast("long")))


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunked(para: Column) -> Column:
    """The chunks of a paragraph, as its bytes read in Latin-1: the expression sees the bits of every character."""
    return F.split(F.decode(F.encode(para, "UTF-8"), "ISO-8859-1"), CHUNK_END)


def fingerprint(text: Column) -> Column:
    """The lanes of a text's fingerprint, in hexadecimal."""
    return F.transform(F.array(text), lambda t: _of(paragraphs(t)))[0]


def _of(paras: Column) -> Column:
    digests = F.transform(paras, lambda p: F.sha2(p, 256))
    chunks = F.flatten(F.transform(paras, chunked))
    hashes = F.transform(F.filter(chunks, lambda c: c != ""), lambda c: F.xxhash64(c))
    both = F.array(F.struct(digests.alias("d"), hashes.alias("h")))
    return F.transform(both, lambda b: _lanes(b["d"], b["h"]))[0]


def _and(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask).cast("long"))


def _equal_lane(digests: Column, lane: int) -> Column:
    """The sum of one 32-bit word of the digests."""
    return _hex(_sum(F.transform(digests, lambda d: F.conv(F.substring(d, 8 * lane + 1, 8), 16, 10).cast("long")), WORD), 8)


def _level_lanes(hashes: Column) -> Column:
    """The sums of a level's lanes. Hashes are dealt in two steps, so that each is looked at 24 times and not LANES."""
    eight, sixteen = (F.array(*[F.lit(i).cast("long") for i in range(n)]) for n in (8, LANES // 8))
    zero = F.lit(0).cast("long")

    # Level, lane and value are taken from different bits of the hash. Odd values, so that few copies of a chunk can't add up to zero.
    def total(own: Column, lane: Column) -> Column:
        mine = lambda h: _and(F.shiftrightunsigned(h, 19), LANES // 8 - 1) == lane
        value = lambda h: _and(F.shiftrightunsigned(h, 40), BYTE).bitwiseOR(F.lit(1).cast("long"))
        sum_ = F.aggregate(own, zero, lambda a, h: F.when(mine(h), a + value(h)).otherwise(a))
        # The third digit keeps a leading zero.
        return F.substring(F.hex(_and(sum_, BYTE) + BYTE + 1), 2, 2)

    def run(own: Column) -> Column:
        return F.when(F.size(own) == 0, F.lit("0" * (LANES // 4))).otherwise(F.array_join(F.transform(sixteen, lambda lane: total(own, lane)), ""))

    runs = F.transform(eight, lambda part: F.transform(F.array(F.filter(hashes, lambda h: _and(F.shiftrightunsigned(h, 16), 7) == part)), run)[0])
    return F.lower(F.array_join(runs, ""))


def _levels(hashes: Column, level: int = 0) -> Column:
    """The lanes of this level and of the thinner ones, each of what the one before has left."""
    own = _level_lanes(hashes)
    if level == LEVELS - 1:
        return own
    kept = F.filter(hashes, lambda h: _and(h, (1 << ((level + 1) * THIN)) - 1) == 0)
    rest = F.transform(F.array(kept), lambda k: F.when(F.size(k) == 0, F.lit("0" * (2 * LANES * (LEVELS - 1 - level)))).otherwise(_levels(k, level + 1)))[0]
    return F.concat(own, rest)


def _lanes(digests: Column, hashes: Column) -> Column:
    counts = [_hex(F.size(digests), 8), _hex(F.size(hashes), 8)]
    equal = [_equal_lane(digests, i) for i in range(EQUAL)]
    return F.concat(*counts, *equal, _levels(hashes))


def _number(fp: Column, at: int | Column, digits: int) -> Column:
    return F.conv(fp.substr(F.lit(at) + 1, F.lit(digits)), 16, 10).cast("long")


def _combined(left: Column, right: Column, sign: int) -> Column:
    def added(pair: Column, at: Column, digits: int, mask: int) -> Column:
        return _hex(_and(_number(pair["l"], at, digits) + sign * _number(pair["r"], at, digits), mask), digits)

    wide = F.array(*[F.lit(8 * i) for i in range(2 + EQUAL)])
    narrow = F.sequence(F.lit(8 * (2 + EQUAL)), F.lit(8 * (2 + EQUAL) + 2 * (LEVELS * LANES - 1)), F.lit(2))
    pair = F.array(F.struct(left.alias("l"), right.alias("r")))
    lanes = F.transform(pair, lambda p: F.concat(F.transform(wide, lambda at: added(p, at, 8, WORD)), F.transform(narrow, lambda at: added(p, at, 2, BYTE))))
    return F.array_join(lanes[0], "")


def insert(fp: Column, added: Column) -> Column:
    """The fingerprint of a document with the paragraphs of both."""
    return _combined(fp, added, 1)


def delete(fp: Column, removed: Column) -> Column:
    return _combined(fp, removed, -1)


def likeness(left: Column, right: Column) -> Column:
    """An estimate of the Jaccard similarity of the chunks of two documents, from their fingerprints; 1 if these are equal."""
    base = 8 * (2 + EQUAL)
    n = _number(left, 8, 8) + _number(right, 8, 8)
    least = F.abs(_number(left, 8, 8) - _number(right, 8, 8)).cast("double")
    lanes = F.array(*[F.lit(i + 1) for i in range(LANES)])
    starts = F.array(*[F.lit(base + 2 * LANES * level + 1) for level in range(LEVELS)])

    def agreeing(l: Column, r: Column) -> Column:
        pair = F.array(F.struct(F.unhex(l).alias("l"), F.unhex(r).alias("r")))
        same = F.transform(pair, lambda p: F.size(F.filter(lanes, lambda i: p["l"].substr(i, F.lit(1)) == p["r"].substr(i, F.lit(1)))))
        return F.when(l == r, 1.0).otherwise(same[0] / float(LANES))

    # The columns stay outside of functions' bodies, where the name of a column could be taken for an alias beside it.
    def of_levels(both: Column) -> Column:
        run = lambda x, at: both[x].substr(at, F.lit(2 * LANES))
        return F.transform(starts, lambda at: agreeing(run("l", at), run("r", at)))

    shares = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), of_levels)
    rate = F.log(F.lit(1 - 1 / LANES))

    def differ(shares: Column, level: int) -> Column:
        return F.log(F.greatest(shares[level], F.lit(0.5 / LANES))) / rate * float(1 << (level * THIN))

    def judged(shares: Column) -> Column:
        found = differ(shares, LEVELS - 1)
        for level in reversed(range(LEVELS - 1)):
            # A thinned level is a sample; the next one is another, if smaller.
            own = 0.75 * differ(shares, level) + 0.25 * differ(shares, level + 1) if level else differ(shares, 0)
            found = F.when(shares[level] >= ENOUGH, own).otherwise(found)
        return found

    found = F.transform(shares, judged)[0]
    found = F.greatest(found, least)
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - found) / F.greatest(n + found, F.lit(1.0))))
    return F.when(left == right, F.lit(1.0)).otherwise(F.least(estimate, F.lit(0.999)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and its fingerprint, next_text, next_fingerprint: of the next document by doc_id, for the last one of the first.

    Rows are dealt into buckets by ranges of the id, and the first rows of each bucket are dealt into
    the bucket before as well, so that one shuffle of the texts is all, and no task sees more than a range.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(own, "doc_id", BUCKETS_PER_PARTITION * partitions(spark))
    own = own.withColumn("bucket", range_index(F.col("doc_id"), bounds))
    # One row per bucket, and there are at most BUCKETS_PER_PARTITION of those per shuffle partition.
    heads = sorted(own.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect())
    if not heads:
        heads = [Row(bucket=0, head=None)]
    # The last bucket is followed by the first one, whose first rows come behind all others there.
    rows = [(heads[i]["bucket"], heads[i]["head"], heads[i - 1]["bucket"], int(i == 0)) for i in range(len(heads))]
    firsts = spark.createDataFrame(rows, "b int, head long, before int, last int")
    own = own.join(F.broadcast(firsts), F.col("bucket") == F.col("b"))
    copied = F.col("doc_id").eqNullSafe(F.col("head"))
    place = lambda b, kind, late: F.struct(b.alias("bucket"), F.lit(kind).alias("copy"), late.alias("late"))
    home = place(F.col("bucket"), False, F.lit(0))
    also = place(F.col("before"), True, F.col("last"))
    own = own.select("doc_id", "text", F.explode(F.when(copied, F.array(home, also)).otherwise(F.array(home))).alias("p"))
    own = own.select("doc_id", "text", "p.*")
    order = Window.partitionBy("bucket").orderBy("late", F.col("doc_id").asc_nulls_last(), "copy", "text")
    own = own.withColumns({"next_text": F.lead("text").over(order), "fingerprint": fingerprint(F.col("text"))})
    own = own.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where(~F.col("copy"))
    return own.select(
        "doc_id",
        "text",
        "fingerprint",
        F.coalesce("next_text", "text").alias("next_text"),
        F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) AS INT))"), F.col("next_text").substr(F.lit(1), cut))
    docs = docs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(edited).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
