"""Secret scan: long tokens found by a pattern, false positives removed by a random forest. SQL functions and Spark ML only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words near a finding that speak for or against a secret, and parts of paths that hold samples. A "_" parts words.
_KEYS = r"token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|authorization|bearer|credential\w{0,4}|client[_-]?secret|signature|key"
_END = r"(?![\p{L}\p{N}])"
# A run of 20 characters, "=" only as its padding; or what is assigned to a key word, from 8 characters on.
_LONG = rf"(?<![\p{{L}}\p{{N}}+/_-])[A-Za-z0-9+/_-]{{20,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?{_END}"
_ASSIGNED = rf"(?<=[:=]\s{{0,3}}[\"'`]?)(?<=(?i:{_KEYS})[\"'`]?\s{{0,3}}[:=]\s{{0,3}}[\"'`]?)(?![:=\s\"'`])[^\s\"'`,;<>(){{}}\[\]]{{8,}}+"
# A private key is one finding with all its lines.
_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\s{1,3}Proc-Type: 4,ENCRYPTED\s{1,3}DEK-Info: \S{1,80})?[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = f"{_KEY_BLOCK}|{_LONG}|{_ASSIGNED}"
SECRET_WORDS = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_KEYS}){_END}"
HARMLESS_WORDS = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:sha1|sha256|sha512|md5|checksum|digest|integrity|commit|revision|uuid|guid|etag|hash|example|sample|dummy|placeholder|test|id|file|path|url|href|src){_END}"
SAMPLE_PATHS = r"(?i)(test|example|sample|fixture|doc|mock|spec|vendor|node_modules|\.lock)"
# Words for a corpus that has hardly any.
FEW_WORDS = tuple("about data default file first from have image index information list management model name other page path people server some table text that this time type user value view with work world".split())
FEATURES = ("length", "transitions", "digits", "uppers", "distinct", "vowel_pairs", "coverage", "padding", "block", "secret_before", "harmless_before", "assigned", "quoted", "sample_path")


def dictionary(docs: DataFrame, text: str = "text", size: int = 400) -> list[str]:
    """The ``size`` words (three letters or more, lower case) found most often in all texts: what the coverage feature knows."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}]{3,}+"), F.lit(0))).alias("word"))
    return [r["word"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A row per candidate: doc_id, path, n (from 0), candidate, before (60 characters), after (20 characters).

    Each segment of a dotted token is a candidate; its ``before`` ends where the token begins.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # A candidate has 8 characters at least, so what stands before is within the last ten; 200 characters of each will do.
    earlier = "array_join(transform(sequence(greatest(n - 10, 0), n), k -> concat(if(k > greatest(n - 10, 0), right(found[k - 1], 200), ''), right(gaps[k], 200))), '')"
    token = r"regexp_replace({}, '(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]+[.])+$', '')"
    each = f"transform(found, (c, n) -> struct(n, c as candidate, right({token.format(earlier)}, 60) as before, left(concat(left(gaps[n + 1], 20), left(coalesce(get(found, n + 1), ''), 20)), 20) as after))"
    return rows.select("doc_id", "path", F.inline(F.expr(each)))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def features(found: DataFrame, words: Sequence[str]) -> DataFrame:
    """Adds the forest's features; null neighbours and paths count as empty. ``coverage`` is the share of characters in ``words``."""
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("before", "after", "path"))
    near = F.regexp_extract(before, r"([^\n]{0,32})$", 1)
    lower = F.lower("candidate")
    c = {
        "length": F.length("candidate").cast("double"),
        "transitions": _share(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "vowel_pairs": _share("(?i)[aeiouy](?=[b-df-hj-np-tv-xz])"),
        "coverage": F.lit(1.0) - F.length(F.regexp_replace(lower, known, "")) / F.length("candidate") if known else F.lit(0.0),
        "padding": _share("[-_/=+]"),
        "block": F.col("candidate").startswith("-----BEGIN").cast("double"),
        "secret_before": near.rlike(SECRET_WORDS).cast("double"),
        "harmless_before": near.rlike(HARMLESS_WORDS).cast("double"),
        "assigned": near.rlike(r"[:=]\s*[\"'`]?$").cast("double"),
        "quoted": (near.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).cast("double"),
        "sample_path": path.rlike(SAMPLE_PATHS).cast("double"),
    }
    return found.withColumns({k: c[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, vocabulary: Sequence[str] = FEW_WORDS, rows: int = 6000) -> DataFrame:
    """Made-up labelled findings (candidate, before, after, path, label) from a rule: keys that are assigned and private keys, against
    words of ``vocabulary``, digests, identifiers, paths, fillers and encoded data. A bounded training set for when there is no labelled one."""
    vocabulary = [w for w in vocabulary if w.isascii()] or list(FEW_WORDS)
    h = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.col("id"), F.lit("x")), 256))
    b64 = F.translate(F.base64(F.unhex(h)), "\n", "")
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100))
    n = (F.lit(20) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(44))).cast("int")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.element_at(F.array(*map(F.lit, vocabulary)), (F.pmod(F.xxhash64("id", k), F.lit(len(vocabulary))) + 1).cast("int"))), "")

    def one_of(salt: int, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    kind = F.pmod(F.col("id"), F.lit(12))
    hexes, mixed = F.substring(h, 1, 64).substr(F.lit(1), n), b64.substr(F.lit(1), n)
    key = one_of(3, 'token = "', 'secret = "', "api_key: ", "password=", 'access_key = "', "Authorization: Bearer ", 'client_secret: "', "auth_token='", "token=", "API_SECRET=", 'AWS_SECRET_ACCESS_KEY = "', "AWS_SECRET_ACCESS_KEY=", '"password": "', "token=SG.")
    assigned = one_of(10, 'password = "', "password=", "DB_PASSWORD=", "secret: ", 'token: "', "pwd='", "auth_token=", '"api_key": "')
    plain = one_of(4, "the ", "of a ", "and then ", "", "see ", "at www.", "import org.")
    digest = one_of(5, "sha256: ", "checksum ", "commit ", "md5 = ", "uuid: ", "etag: ", "integrity=", "commit=")
    long = F.array_join(F.transform(F.sequence(F.lit(0), (n * 2).cast("int")), lambda k: F.translate(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), k.cast("string")), 256))), "\n=", "")), "")
    pem = F.concat(one_of(15, "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"), F.lit("\n"), F.regexp_replace(long, "(.{64})", "$1\n"), F.lit("\n"), one_of(15, "-----END PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"))
    upper = F.when(at < 10, F.upper(hexes)).otherwise(hexes)
    short = (F.lit(8) + F.pmod(F.xxhash64("id", F.lit(11)), F.lit(12))).cast("int")
    mark = one_of(12, "", "", "!", "#", "$", "@", "%")
    chosen = F.concat(b64.substr(F.lit(3), short), mark, F.pmod(F.xxhash64("id", F.lit(13)), F.lit(100)).cast("string"))
    named = F.when(at < 60, words.substr(F.lit(1), short)).otherwise(one_of(14, "required", "os.environ", "your_password", "changeme_please", "undefined", "settings.password", "process.env.TOKEN", "${PASSWORD}", "self.secret_key", "********"))
    rows_ = spark.range(0, rows, 1, 4)
    candidate = F.when(kind.isin(0, 1), upper).when(kind.isin(2, 3), mixed).when(kind == 4, words).when(kind == 5, hexes).when(kind == 6, F.concat_ws("/", words.substr(1, 9), words.substr(10, 9), words.substr(3, 12))).when(kind == 7, F.repeat(one_of(6, "x", "0", "ab", "-", "_", "1234567890"), 30).substr(F.lit(1), n)).when(kind == 8, chosen).when(kind == 10, pem).when(kind == 11, long).otherwise(named)
    before = F.when(kind.isin(0, 1, 2, 3), key).when(kind == 5, digest).when(kind == 7, F.when(at < 50, key).otherwise(plain)).when(kind.isin(8, 9), assigned).when(kind == 11, one_of(16, "data:image/png;base64,", "src=\"data:font/woff2;base64,", "url(data:image/gif;base64,", "content: ", "body = \"", "cert: ")).otherwise(F.when(at < 5, key).otherwise(plain))
    after = F.when(F.expr("right(b, 1)") == '"', '" ').otherwise(one_of(7, " ", "\n", ""))
    path = F.when(at < 15, one_of(8, "tests/a.py", "docs/readme.md", "example.cfg")).otherwise(one_of(9, "src/app.py", "lib/client.js", "config.yml", "web", ""))
    out = rows_.select("id", candidate.alias("candidate"), F.concat(plain, before).alias("before"), before.alias("b"), path.alias("source"), kind.isin(0, 1, 2, 3, 8, 10).cast("double").alias("label"))
    docs = out.select(F.struct("candidate", "label").alias("doc_id"), F.concat("before", "candidate", after).alias("text"), "source")
    # As scan() finds them; a key's name is no secret.
    found = candidates(docs)
    return found.select("candidate", "before", "after", "path", F.when(F.contains("doc_id.candidate", "candidate"), F.col("doc_id.label")).otherwise(0.0).alias("label"))


def _vectors(found: DataFrame, words: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found, words))


def fit_forest(labelled: DataFrame, words: Sequence[str], trees: int = 20, depth: int = 6, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest on labelled findings: candidate, before, after, path (strings, as ``candidates`` gives them) and label (0 or 1,
    null rows are left out). ``words`` is the coverage feature's dictionary."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(_vectors(labelled.where(F.col("label").isNotNull() & (F.length("candidate") > 0)), words))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A row per candidate of every whole text: doc_id, n, candidate, before, after, score, is_secret.

    ``score`` is the forest's probability of a secret. The forest learns from ``labelled`` findings (see ``fit_forest``), or without
    any from made-up ones; the dictionary from all texts. Null and empty texts have no candidate; very long ones are scanned in
    whole, in one pass; repeated rows and ids are scanned each; null ids and paths stay; equal candidates have equal scores where their
    neighbours and path are equal. Empty tables give no rows. Other columns are left out, whatever their names.
    """
    words = dictionary(docs, text)
    model = fit_forest(labelled_findings(docs.sparkSession, words or FEW_WORDS) if labelled is None else labelled, words)
    out = model.transform(_vectors(candidates(docs, doc_id, text, path), words))
    score = vector_to_array("probability")[1]
    return out.select("doc_id", "n", "candidate", "before", "after", score.alias("score"), (score >= threshold).alias("is_secret"))
