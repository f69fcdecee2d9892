"""Secret scans with a random forest that removes false positives.

Candidates are words with a stretch of ten or more letters and digits mixed,
tokens with a known beginning, the bodies of private keys, and of any shape what
a secret word is assigned or what follows it. A forest judges each by its
length, the transitions between its kinds of characters, how much of it the
corpus's frequent words cover, whether it is a path, and the neighbouring words.

It is trained from labelled findings: those of one's own, or those that the
corpus gives by their places (values assigned to a secret word or with a known
beginning against digests, identifiers, paths and plain words), every other one
shown without its neighbours, so that the value itself must tell; and beside
either, findings built by rule (``example_findings``). Only DataFrame functions
and the DataFrame-based forest are used.

Not found away from a secret word: runs under ten characters, of letters or
digits alone, or with other signs; nowhere: values with spaces, and of a value
the punctuation at its end and what follows a quotation mark.

Defined cases: null, empty and plain texts have no finding; repeated rows and
repeated findings give a row each; findings without a candidate or a label are
left out, and a table of them that is empty or has one label only is completed by
the built ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import let, staged, words

#: Beginnings of tokens that services issue.
ISSUED = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_)"
CANDIDATE = rf"(?<![A-Za-z0-9+/_.-])(?:(?=[A-Za-z+/_.-]*[0-9])(?=[0-9+/_.-]*[A-Za-z])[A-Za-z0-9+/_.-]{{9,}}[A-Za-z0-9+/_-]|{ISSUED}[A-Za-z0-9_-]{{12,}})"
KEY_BLOCK = r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)([^-]+)-----END"
#: Words near secrets, words near harmless codes, and words that make up harmless names.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "akia")
#: The value that a secret word is assigned in its own word, and a secret word, or one with a sign of assignment, that ends a word.
ASSIGNED = rf"(?i)(?:{'|'.join(SECRET_WORDS[:-1])})[\"'\])]*[:=]+>?[\"'(\[]*([^\s\"']*[^\s\"'.,;:!?=()\[\]{{}}])"
NAMES = rf"(?i)(?:{'|'.join(SECRET_WORDS[:-1])})[\"'\])]*[:=]*>?$"
JOINS = r"(?i)^(?:[:=]+>?|->|is|was|are|to)$"
VALUE = r"^[\"'(\[]*([^\s\"']*[^\s\"'.,;:!?=()\[\]{}<>-])"
HARMLESS_WORDS = ("commit", "sha", "md5", "hash", "checksum", "uuid", "guid", "revision", "version", "digest", "etag", "isbn", "order", "invoice", "example", "build", "file", "path")
ORDINARY_WORDS = ("example", "sample", "test", "user", "name", "value", "config", "default", "placeholder", "your", "index", "module", "class", "version", "data", "file", "list", "item", "page", "image", "service", "server", "client", "table", "main", "util", "core", "lib", "src")
#: Plain words that follow secret words in prose.
PLAIN_WORDS = ("for", "and", "was", "of", "in", "that", "must", "policy", "which", "manager", "service", "field", "expired", "should", "management", "authentication")
FEATURES = ["length", "transitions", "distinct", "digits", "uppers", "vowels", "hexadecimal", "covered", "path", "issued", "assigned", "near_secret", "near_harmless"]
#: The forest is trained on about so many labelled findings, by a hash if there are more.
MAX_FIT_ROWS = 20_000
#: The dictionary: so many words of four letters or more that stand in most documents, at least in so many.
DICTIONARY, MIN_DOCUMENTS = 1_000, 5
TREES, DEPTH = 24, 6


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the word), candidate, lead (what stands before it in its word), before and after (the neighbouring words)."""
    shaped = lambda x: F.regexp_extract_all(x, F.lit(CANDIDATE), 0)
    follows = lambda w, i: F.coalesce(F.get(w, i - 1).rlike(NAMES) | (F.get(w, i - 1).rlike(JOINS) & F.get(w, i - 2).rlike(NAMES)), F.lit(False))

    def named(w: Column, x: Column, i: Column) -> Column:  # what a secret word is assigned, or what follows it
        after = F.when(follows(w, i) & ~x.rlike(JOINS), F.regexp_extract(x, VALUE, 1)).otherwise("")
        return F.array(F.regexp_extract(x, ASSIGNED, 1), after)

    found = lambda w, x, i: let(shaped(x), lambda s: F.concat(s, F.filter(F.array_distinct(named(w, x, i)), lambda v: (v != "") & ~F.array_contains(s, v))))
    around = lambda w: F.filter(
        F.transform(w, lambda x, i: F.struct(i.cast("long").alias("place"), x.alias("word"), F.concat_ws(" ", F.get(w, i - 3), F.get(w, i - 2), F.get(w, i - 1)).alias("before"), F.concat_ws(" ", F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)).alias("after"), found(w, x, i).alias("found"))),
        lambda s: F.size(s["found"]) > 0,
    )
    maybe = docs.where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(rf"(?i)(?:{'|'.join(SECRET_WORDS[:-1])}|private key)"))
    rows = maybe.select("doc_id", F.explode(let(words(F.col("text")), around)).alias("s"))
    each = rows.select("doc_id", "s.*").withColumn("candidate", F.explode("found"))
    each = each.select("doc_id", "place", "candidate", F.expr("substring_index(word, candidate, 1)").alias("lead"), "before", "after")
    blocks = maybe.select("doc_id", "text", F.explode(F.zip_with(*[F.regexp_extract_all("text", F.lit(KEY_BLOCK), i) for i in (1, 2)], lambda h, b: F.struct(h.alias("lead"), b.alias("candidate")))).alias("s"))
    blocks = blocks.where(F.trim("s.candidate") != "").select("doc_id", F.size(words(F.expr("substring_index(text, s.candidate, 1)"))).cast("long").alias("place"), "s.candidate", "s.lead", F.lit("").alias("before"), F.lit("").alias("after"))
    return each.unionByName(blocks)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of four letters or more that stand in most documents; at most ``size`` of them."""
    seen = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,24}"), 0))).alias("w"))
    most = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in most.collect()]


def _share(c: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def features(found: DataFrame, frequent: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Adds ``FEATURES``; ``frequent`` are the corpus's words beside ``ORDINARY_WORDS``."""
    covering = "|".join(sorted({*frequent, *ORDINARY_WORDS}, key=lambda w: (-len(w), w)))
    c = F.col("candidate")
    near = F.lower(F.concat_ws(" ", "before", "lead", F.substring("candidate", 1, 4), "after"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"), "[^aA9]+", "-")
    hits = lambda names: sum((near.rlike(rf"(?<![a-z]){w}s?(?![a-z])").cast("int") for w in names), F.lit(0))  # noqa: E731  whole words: no author is an auth, no border an order
    return found.select(
        "*",
        F.length(c).cast("double").alias("length"),
        ((F.length(kinds) - 1) / F.greatest(F.length(c) - 1, F.lit(1))).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1))).alias("distinct"),
        _share(c, "[0-9]").alias("digits"),
        _share(c, "[A-Z]").alias("uppers"),
        _share(c, "[aeiouAEIOU]").alias("vowels"),
        c.rlike("^[0-9a-f]+$").cast("double").alias("hexadecimal"),
        _share(F.lower(c), covering).alias("covered"),
        (F.size(F.split(c, "[/.]")) - 1).cast("double").alias("path"),
        c.rlike(f"^{ISSUED}").cast("double").alias("issued"),
        F.coalesce(F.col("lead").rlike("[=:\"'(]$").cast("double"), F.lit(0.0)).alias("assigned"),
        hits((*SECRET_WORDS, "private key")).cast("double").alias("near_secret"),
        hits(HARMLESS_WORDS).cast("double").alias("near_harmless"),
    )


def example_findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """Labelled findings by rule: codes in the places where secrets stand (label 1), and digests, identifiers, versions, names and paths where those stand (label 0)."""
    code = lambda seed, low, high: F.substr(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), F.lit(1), (low + F.col("id") % (high - low)).cast("int"))
    caps = F.concat(F.lit("AKIA"), F.substring(F.translate(F.upper(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), F.col("id").cast("string")), 256)))), "+/=", "QXZ"), 1, 16))
    mixed = F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), F.col("id").cast("string")), 256))), 1, 32)
    uuid = F.regexp_replace(code("u", 32, 33), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") / 16 % len(names)).cast("int") + 1)
    word = lambda: pick(ORDINARY_WORDS)
    path = F.concat(F.lit("src/"), word(), F.lit("/"), F.reverse(word()), F.col("id").cast("string"), F.lit("/main.py"))
    name = F.concat(word(), F.lit("_"), F.element_at(F.array(*map(F.lit, ORDINARY_WORDS)), (F.col("id") / 7 % len(ORDINARY_WORDS)).cast("int") + 1), F.lit("_"), F.col("id").cast("string"))
    secret, harmless = pick(SECRET_WORDS[:-1]), pick(HARMLESS_WORDS)
    none = F.lit("")
    letters = F.translate(code("l", 14, 26), "0123456789", "ghijklmnop")
    short = F.concat(F.substring(F.translate(F.base64(F.unhex(code("s", 32, 33))), "+/=", "xyz"), 1, 6), (F.col("id") % 10).cast("string"))
    signs = F.concat(F.substring(short, 1, 5), F.lit("&"), F.substring(mixed, 1, 5), F.lit("!"), F.substring(mixed, 6, 2))
    kinds = [
        (code("p", 12, 24), F.concat(secret, F.lit("=")), none, 1), (code("t", 40, 41), F.lit('"'), F.concat(secret, F.lit(" =")), 1), (caps, none, none, 1), (caps, F.concat(secret, F.lit(":")), none, 1),
        (mixed, F.lit('"'), F.concat(secret, F.lit(":")), 1), (code("q", 16, 48), none, F.concat(F.lit("the "), secret, F.lit(" is")), 1),
        (code("g", 40, 41), none, harmless, 0), (code("h", 12, 64), F.concat(harmless, F.lit(":")), none, 0), (uuid, none, none, 0), (uuid, F.lit('"'), F.concat(harmless, F.lit(" =")), 0),
        (path, none, F.lit("see"), 0), (path, F.lit("("), harmless, 0), (name, none, F.lit("the"), 0), (name, F.lit('"'), F.concat(secret, F.lit(" =")), 0), (F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(".10.2-beta3")), none, harmless, 0), (F.concat(name, F.lit("x")), F.concat(harmless, F.lit("=")), none, 0),
        *[(c, F.concat(secret, F.lit("=")), none, 1) for c in (letters, short, signs)], *[(c, none, F.concat(F.lit("the "), secret, F.lit(" is")), 1) for c in (letters, short, signs)],
        *[(pick(PLAIN_WORDS), none, F.concat(F.lit("the "), secret, F.lit(joined)), 0) for joined in ("", "", " is")], (word(), none, F.concat(F.lit("the "), secret), 0), (word(), none, F.concat(F.lit("the "), secret, F.lit(" is")), 0), (word(), F.concat(secret, F.lit("=")), none, 0),
        (code("a", 16, 48), none, none, 1, F.concat(F.lit("is "), secret)), (code("b", 12, 64), none, none, 0, F.concat(F.lit("is "), harmless)),
    ]
    case = F.array(*[F.struct(c.alias("candidate"), lead.alias("lead"), before.alias("before"), (after[0] if after else none).alias("after"), F.lit(y).cast("double").alias("label")) for c, lead, before, y, *after in kinds])
    return spark.range(n).select(F.element_at(case, (F.col("id") % len(kinds)).cast("int") + 1).alias("f")).select("f.*")


def corpus_findings(found: DataFrame, frequent: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Labelled findings among candidates, told by their places; the others are left out. Every other one loses its neighbours."""
    c, lead = F.col("candidate"), F.coalesce("lead", F.lit(""))
    last = F.lower(F.element_at(F.split(F.coalesce("before", F.lit("")), " "), -1))
    plain = F.lower(c).isin(*{*frequent, *ORDINARY_WORDS, *PLAIN_WORDS})
    given = (lead.rlike(rf"(?i)(?:{'|'.join(SECRET_WORDS[:-1])})[\"'\])]*[:=]+>?[\"'(\[]*$") | c.rlike(f"^{ISSUED}") | lead.contains("PRIVATE KEY")) & ~plain
    digest = last.rlike(rf"^(?:{'|'.join(HARMLESS_WORDS)})[:=#]*$") | c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-|/.*\.[a-z]{1,4}$|^\d+\.\d+\.\d+")
    label = F.when(given, 1.0).when(digest | plain, 0.0)
    bare = F.pmod(F.xxhash64("candidate", F.lit("bare")), F.lit(2)) == 0
    shown = [F.when(bare, "").otherwise(F.col(k)).alias(k) for k in ("lead", "before", "after")]
    return found.select("candidate", *shown, label.alias("label")).where("label is not null")


def train(findings: DataFrame, max_rows: int = MAX_FIT_ROWS, frequent: list[str] | tuple[str, ...] = ()) -> PipelineModel:
    """A forest from labelled findings: candidate, lead, before, after and label 0 or 1."""
    known = ["candidate", "lead", "before", "after", F.col("label").cast("double").alias("label")]
    usable = findings.where("label is not null and candidate is not null").select(*known)
    by_label = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(by_label.values())
    if total > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("candidate", "lead", "before", "after"), F.lit(1_000_000)) < int(max_rows / total * 1_000_000))
    if len(by_label) < 2:
        usable = usable.unionByName(example_findings(findings.sparkSession))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(usable, frequent))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, labelCol="label", featuresCol="features").fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, place, candidate, score and is_secret of every candidate in the whole texts."""
    found = staged(candidates(docs), "candidates")
    frequent = dictionary(docs)
    if findings is None:
        findings = corpus_findings(found, frequent).unionByName(example_findings(docs.sparkSession))
    forest = train(findings, frequent=frequent)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found, frequent))
    score = vector_to_array(F.col("probability"))[1]
    return forest.transform(rows).select("doc_id", "place", "candidate", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))
