"""Secret scan with a random forest that removes false positives (DataFrame functions and Spark's own trees only).

Candidates are all runs of at least LEAST_LENGTH key characters in the words of a text.
A random forest, trained on labelled findings, decides which stay. Its features are
the candidate's length, its character transitions (changes of class, shares of
classes, letter pairs), how much of it dictionary parts cover (the most frequent
word starts of the corpus, counted over all documents), the path that the document
has, and what is next to it: in its word up to a separator, and the next words where
the word has no more on that side.

Labelled findings come as a table word, before, before2, after, path, label; one is
made here by rule (``labelled_findings``): keys of usual shapes in assignments
against checksums, identifiers, numbers, placeholders, links and joined words.

Cases: a null text has no candidates; null paths and missing neighbours are empty;
a candidate at either end of a text has empty neighbours; equal findings at
different places are all kept; rows of equal id are scanned each; an empty table
gives no rows; other columns are ignored. Findings carry a digest and a masked
form, never the secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

LEAST_LENGTH = 16
CORE = r"([A-Za-z0-9+/_\-]{16,}={0,2})"
#: What parts the fields of a word without blanks.
PARTED = r"[^,;&?{}|]*"
#: Dictionary parts: the most frequent words' starts, of so many letters.
PARTS, PART_LETTERS = 300, 3
TREES, DEPTH, SEED = 30, 7, 11
SECRET_FROM = 0.5
FEATURES = [
    "n", "turns", "digits", "uppers", "hexes", "signs", "vowels", "pairs", "repeats", "covered", "hinted", "assigned", "quoted", "checked",
    "placeholder", "test_path", "linked", "plain_next",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, place (number of the word), run (of the word's, from 0), word (a run's field), core, lead, trail, before, before2, after. ``docs``: doc_id, text, path."""
    own = docs.where(F.length("text") >= LEAST_LENGTH).select("doc_id", "path", F.split("text", r"\s+").alias("w"))
    hit = lambda x: (F.length(x) >= LEAST_LENGTH) & x.rlike(CORE)
    own = own.select("doc_id", "path", "w", F.explode(F.filter(F.transform("w", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())).alias("place"))
    near = lambda k: F.coalesce(F.get("w", F.col("place") + k), F.lit(""))
    own = own.select("doc_id", "path", "place", near(0).alias("word"), near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"))
    return runs(own)


def runs(found: DataFrame) -> DataFrame:
    """A row for each run of a word: run, core, lead and trail (what is before and after it in its field), word (the field); neighbours are empty if the word has more on that side."""
    every = found.withColumns({"_cores": F.regexp_extract_all("word", F.lit(CORE), F.lit(1)), "_gaps": F.split("word", CORE)})
    every = every.select("*", F.posexplode("_cores").alias("run", "core"))
    chars = lambda x: f"aggregate({x}, 0, (a, y) -> a + length(y))"
    start = F.expr(f"{chars('slice(_gaps, 1, run + 1)')} + {chars('slice(_cores, 1, run)')}")
    front, rest = F.col("word").substr(F.lit(1), start), F.col("word").substr(start + F.length("core") + 1, F.length("word"))
    every = every.withColumns({"_front": front, "_rest": rest})
    every = every.withColumns({"lead": F.regexp_extract("_front", PARTED + "$", 0), "trail": F.regexp_extract("_rest", "^" + PARTED, 0)})
    fields = F.expr("substring(_front, 1, length(_front) - length(lead))")
    first, last = ~fields.rlike(r"[\p{L}\p{N}]"), F.col("_rest") == F.col("trail")
    blank = {x: F.when(first, F.col(x)).otherwise("") for x in ("before", "before2")} | {"after": F.when(last, F.col("after")).otherwise("")}
    return every.withColumns(blank).withColumn("word", F.concat("lead", "core", "trail")).drop("_cores", "_gaps", "_front", "_rest")


def dictionary(docs: DataFrame, parts: int = PARTS) -> list[str]:
    """The most frequent starts of the corpus's words, weighted by how often words occur; ``parts`` strings go to the driver."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= PART_LETTERS)
    starts = words.select(F.substring("w", 1, PART_LETTERS).alias("p")).groupBy("p").count()
    found = starts.where(F.col("p").rlike("^[a-z]+$")).orderBy(F.desc("count"), "p").limit(parts)
    return sorted(r["p"] for r in found.collect())


def featured(found: DataFrame, parts: list[str]) -> DataFrame:
    """``found``: as ``runs`` makes them."""
    c = F.col("core")
    n = F.length(c)
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    runs = F.length(F.regexp_replace(c, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x"))
    lowered = F.lower(c)
    cover = F.lit(0.0) if not parts else 1 - F.length(F.regexp_replace(lowered, "|".join(parts), "")) / n
    context = F.lower(F.concat_ws(" ", "before2", "before", "lead", F.regexp_replace("trail", CORE, "")))
    path = F.lower(F.coalesce("path", F.lit("")))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "n": n.cast("double"),
            "turns": (runs - 1) / n,
            "digits": share("[^0-9]"),
            "uppers": share("[^A-Z]"),
            "hexes": share("[^0-9a-fA-F]"),
            "signs": share("[A-Za-z0-9]"),
            "vowels": share("[^aeiouAEIOU]"),
            "pairs": (n - F.length(F.regexp_replace(lowered, "[b-df-hj-np-tv-z][aeiou]", ""))) / n,
            "repeats": (n - F.length(F.regexp_replace(lowered, r"(.)\1+", "$1"))) / n,
            "covered": cover,
            "hinted": flag(context.rlike("token|secret|passw|pwd|api.?key|key|auth|bearer|credential")),
            "assigned": flag(F.concat_ws(" ", "before", "lead").rlike(r"[=:]\s*[\"'`]?$")),
            "quoted": flag(F.col("lead").rlike("[\"'`]$")),
            "checked": flag(context.rlike("commit|sha|md5|digest|checksum|hash|etag|integrity|revision")),
            "placeholder": flag(F.concat_ws(" ", context, lowered).rlike("example|sample|dummy|placeholder|your|fake|xxxx|changeme")),
            "test_path": flag(path.rlike("test|spec|fixture|mock|lock|doc")),
            "linked": flag(F.col("word").rlike("://|^www|@|\\.(com|org|net)")),
            "plain_next": flag(F.col("after").rlike("^[a-z]+$")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Findings with labels, made by rule: half are secrets."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(digest(salt))), "=", "")
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    name = pick(1, "token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key")
    syllables = ("the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")
    joined = F.concat(*[pick(20 + k, *syllables) for k in range(9)])
    word = pick(40, "and", "of", "then", "with", "which", "was", "are", "for")
    plain = (word, pick(41, "in", "this", "by", "that", "from"))
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    size = (F.pmod(F.xxhash64(i, F.lit(3)), F.lit(20)) + 20).cast("int")
    s = lambda x: F.lit(x)
    kinds = [  # word, before, before2, label
        (quote(F.sha1(i.cast("string"))), s("="), name, 1),
        (quote(b64("b")), s("="), name, 1),
        (F.concat(name, s("="), b64("c")), plain[0], plain[1], 1),
        (F.concat(s("AKIA"), F.upper(F.substring(digest("d"), 1, 16))), s("="), s("aws_access_key_id"), 1),
        (F.concat(s("ghp_"), F.substring(b64("e"), 1, 36)), plain[0], name, 1),
        (quote(F.substring(digest("f"), 1, size)), s(":"), name, 1),
        (F.substring(b64("g"), 1, 40), s("Bearer"), s("Authorization:"), 1),
        (F.concat(F.substring(digest("h"), 1, 32), s(";")), s("="), name, 1),
        (joined, plain[0], plain[1], 0),
        (F.concat(F.initcap(joined), pick(42, ",", ".", "", "!!")), plain[0], plain[1], 0),
        (F.upper(joined), plain[0], plain[1], 0),
        (F.sha1(F.concat(s("r"), i.cast("string"))), pick(43, "commit", "sha1:", "checksum", "revision", "digest:"), plain[0], 0),
        (F.lpad(F.conv(F.substring(digest("n"), 1, 12), 16, 10), 16, "4"), plain[0], plain[1], 0),
        (quote(F.concat(pick(44, "your-", "example-", "dummy-", "xxxx"), F.lit("token-goes-here-xxxx"))), s("="), name, 0),
        (F.concat(s("https://"), pick(45, "www.", "m."), joined, s(".com/"), joined), plain[0], plain[1], 0),
        (F.concat(F.substring(joined, 1, 6), s("_"), F.substring(joined, 7, 6), s("_"), pick(46, "handler", "index", "value", "count")), s("="), plain[0], 0),
    ]
    k = F.pmod(i, F.lit(len(kinds)))
    choose = lambda j: reduce(lambda acc, x: F.when(k == x[0], x[1][j]).otherwise(acc), enumerate(kinds), F.lit(None))
    return spark.range(n).select(
        choose(0).alias("word"),
        choose(1).alias("before"),
        choose(2).alias("before2"),
        word.alias("after"),
        pick(47, "src/app.py", "config/prod.env", "notes.txt", "src/main.c").alias("path"),
        reduce(lambda acc, x: F.when(k == x[0], F.lit(x[1][3])).otherwise(acc), enumerate(kinds), F.lit(0)).cast("double").alias("label"),
    )


def train(labelled: DataFrame, parts: list[str]):
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    # A labelled word's label is its first run's.
    return forest.fit(vectors(featured(runs(labelled).where("run = 0"), parts)).select("features", "label"))


def vectors(found: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return found.withColumn("features", array_to_vector(F.array(*FEATURES)))


def scored(found: DataFrame, model, parts: list[str]) -> DataFrame:
    """Candidates with score, the forest's probability of a secret. Of rows without ``core`` the first run counts."""
    from pyspark.ml.functions import vector_to_array

    found = found if "core" in found.columns else runs(found).where("run = 0")
    return model.transform(vectors(featured(found, parts))).withColumn("score", vector_to_array("probability")[1])


def masked(core: Column) -> Column:
    return F.concat(F.substring(core, 1, 4), F.lit("..."), F.length(core).cast("string"))


def scan(docs: DataFrame, labelled: DataFrame, secret_from: float = SECRET_FROM) -> DataFrame:
    """The findings that stay: doc_id, place, n_chars, digest, preview, score. ``docs``: doc_id, text, path."""
    parts = dictionary(docs)
    model = train(save(labelled, "secret-labels"), parts)
    found = scored(candidates(docs), model, parts).where(F.col("score") >= secret_from)
    return found.select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("core", 256).alias("digest"),
        masked(F.col("core")).alias("preview"),
        F.round("score", 6).alias("score"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents; a document's source stands for its path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return scan(docs, labelled_findings(spark))
