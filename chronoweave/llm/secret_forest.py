"""Secret scans with a random forest for the removal of false positives (DataFrame operations only).

Candidates are runs of at least 16 characters of keys and tokens that hold a digit and, where an
assignment or secret word stands right before them, runs of at least 4 without regard to digits. `=` is
part of a run as trailing padding only, so that it starts at the value of `KEY=value`. A forest judges
each by its length, the transitions of its characters, how much of it is dictionary words, signs of
paths, and the words beside it. It is trained by Spark ML, in the JVM, from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SECRET_WORDS = ("api", "auth", "bearer", "credential", "key", "passphrase", "passwd", "password", "pwd", "secret", "token")
SIGNS = "A-Za-z0-9+/_-"
#: What stands right before a run that may be short or without a digit; every lookbehind has a fixed width.
ASSIGNED = "|".join(rf"(?<=[=:]{gap}{q})" for gap in ("", "[ \t]", ">", ">[ \t]") for q in ("", "[\"'`]"))
NAMED = "|".join(rf"(?<={word}[ \t])|(?<={word}[ \t][\"'`])" for word in SECRET_WORDS)
CANDIDATE = rf"(?<![{SIGNS}])(?:(?=[A-Za-z+/_-]*[0-9])[{SIGNS}]{{16,}}|(?=[{SIGNS}]{{4}})(?!//)(?:{ASSIGNED}|(?i:{NAMED}))[{SIGNS}]+)(?:={{1,2}}(?![\"'`]?[={SIGNS}]))?"
#: Characters on either side that are looked at.
BESIDE = 40
TREES, DEPTH, SEED = 20, 7, 5
#: A finding is a secret from this probability on.
THRESHOLD = 0.5

# Fixed word lists, in natural order.
DICTIONARY = (
    "access account address admin application archive assets attachment author backup branch build bundle cache category change "
    "changeme chapter client column commit config content control count country current data date default demo description design "
    "detail device document download dummy edition element email error event example export feature field file filter folder font "
    "form format frame function gallery global group guide handler header history home image import index info input item label "
    "language layout library license link list local login main manager media member menu message method model module month name "
    "network news node number object option order output package page panel parent part path photo placeholder plugin point post "
    "price print process product profile program project public query record release report request resource response result "
    "sample schema screen script search section select server service session setting simple site source start state static status "
    "style summary support system table target task team template test text theme time title tool topic type update upload user "
    "value version video view volume week widget window word work year"
).split()
BENIGN_WORDS = ("blob", "build", "card", "checksum", "commit", "digest", "etag", "fax", "hash", "isbn", "md5", "phone", "revision", "sha", "tel", "uuid", "version")

FEATURES = (
    "length changes distinct digits uppers hexes only_digits covered paths extension url quoted assigned secret_word benign_word left_sign right_sign"
).split()


def findings(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, nth (from 1), candidate, left, right: every candidate of every whole text."""
    has = docs.where(F.col("text").rlike(CANDIDATE))
    parts = has.select(
        "doc_id", *others, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("between")
    )
    # what stands beside a candidate is cut out before the rows multiply, so that a row is short whatever its text
    end = lambda x: F.right(x, F.lit(BESIDE))
    # a name that is a candidate itself still stands before its value
    before = lambda i: F.when(i > 0, end(F.get("c", i - 1))).otherwise("")
    found = F.transform(
        "c",
        lambda c, i: F.struct(
            c.alias("candidate"), end(F.concat(before(i), end(F.get("between", i)))).alias("left"), F.left(F.get("between", i + 1), F.lit(BESIDE)).alias("right")
        ),
    )
    each = parts.select("doc_id", *others, found.alias("found")).select("doc_id", *others, F.posexplode("found").alias("at", "f"))
    return each.select("doc_id", *others, (F.col("at") + 1).cast("bigint").alias("nth"), "f.candidate", "f.left", "f.right")


def _share(count: Column, of: Column) -> Column:
    return (count / F.greatest(of, F.lit(1))).cast("double")


def described(found: DataFrame) -> DataFrame:
    """The features of candidates (candidate, left, right)."""
    c, left, right = F.coalesce("candidate", F.lit("")), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))
    n = F.length(c)
    kept = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "_")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    covered = n - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    beside = lambda words: F.lower(left).rlike(r"(?:^|[^a-z])(?:\w*[_-])?(?:" + "|".join(words) + r")(?:[_-]\w*)?[^a-z]*$")
    number = lambda flag: flag.cast("double")
    values = {
        "length": n.cast("double"),
        "changes": _share(changes, n - 1),
        "distinct": _share(F.size(F.array_distinct(F.split(c, ""))), n),
        "digits": _share(kept("[^0-9]"), n),
        "uppers": _share(kept("[^A-Z]"), n),
        "hexes": _share(kept("[^0-9a-fA-F]"), n),
        "only_digits": number(c.rlike("^[0-9]+$")),
        "covered": _share(covered, n),
        "paths": kept("[^/]").cast("double"),
        "extension": number(right.rlike(r"^\.[A-Za-z]{1,5}\b")),
        "url": number(left.rlike(r"(?:://|www\.|[./@])\S*$")),
        "quoted": number(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "assigned": number(left.rlike("[=:]\\s*[\"'`]?$")),
        "secret_word": number(beside(SECRET_WORDS)),
        "benign_word": number(beside(BENIGN_WORDS)),
        "left_sign": number(left.rlike(r"[^\w\s\"'`=:]$")),
        "right_sign": number(right.rlike(r"^[^\w\s\"'`,;.]")),
    }
    return found.withColumn("features", F.struct(*[values[f].alias(f) for f in FEATURES])).select("*", "features.*").drop("features")


def example_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled findings made by rule: secrets of usual forms and contexts, and what is often taken for them.

    The default where no findings of one's own are given; every text follows from a row number.
    """
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("a"), i.cast("string")).cast("binary"), 256)
    other = F.sha2(F.concat(F.lit("c"), i.cast("string")).cast("binary"), 256)
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")).cast("binary"), 256))), "[+/=\\s]", "x")
    pick = lambda salt, *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    word = lambda salt: pick(salt, *DICTIONARY)
    number = lambda salt, digits: F.lpad(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(10**digits)).cast("string"), digits, "7")
    kind = F.pmod(i, F.lit(17))
    letters = F.translate(hexes, "0123456789", "ghijklmnop")
    signs = lambda salt: pick(salt, ' = "', '="', ": ", "=", ": '", ":", '": "')
    closing = pick("r", '"', "\n", " ", "'")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    cases = [  # candidate, left, right, label
        (F.substring(hexes, 1, 40), F.concat(word("l"), F.lit(" "), pick("s", "token", "secret", "api_key", "auth", "access-token"), pick("e", ' = "', '="', ": ", "=", ": '")), pick("r", '" ', "\n", " ", "' "), 1),
        (F.substring(base, 1, 40), F.concat(pick("s", "password", "SECRET_KEY", "apikey", "client_secret", "bearer"), pick("e", ' = "', " ", ": ", "=")), pick("r", '"', "\n", " "), 1),
        (F.substring(other, 1, 32), F.concat(pick("s", "token", "key", "passwd", "credential"), pick("e", " = '", ":", "=")), pick("r", "'", "\n", " "), 1),
        (F.substring(base, 1, 24), F.concat(word("l"), F.lit(" "), pick("s", "secret", "token", "pwd"), pick("e", "=", ": ")), pick("r", " ", "\n"), 1),
        (F.substring(hexes, 1, 40), F.concat(pick("s", "commit ", "sha1: ", "checksum = ", "revision=", "md5 ", "digest: ")), pick("r", " ", "\n", ")"), 0),
        (uuid, F.concat(word("l"), pick("s", " uuid=", " ", "/", " id ")), pick("r", " ", "/", "\n"), 0),
        (number("d", 16), F.concat(word("l"), pick("s", " card ", " ", " phone ", ". ", "### ")), pick("r", " ", ".", "$$$ "), 0),
        (F.concat_ws("_", word("x"), word("y"), word("z"), number("v", 2)), F.concat(word("l"), pick("s", " ", "/", " = ")), pick("r", ".png", ".html", " ", "("), 0),
        (F.concat(word("x"), F.lit("/"), word("y"), F.lit("/"), word("z"), F.lit("-"), number("v", 3)), pick("s", "https://example.org/", "../", "/usr/share/", " "), pick("r", ".js", " ", "?page=1", ".html"), 0),
        (F.concat(pick("p", "example", "changeme", "placeholder", "test", "dummy"), F.lit("-"), word("x"), F.lit("-"), word("y"), number("v", 2)), F.concat(pick("s", "password", "token", "secret"), F.lit("=")), pick("r", " ", "\n"), 0),
        # short and digit-free ones
        (F.substring(base, 1, 10), F.concat(word("l"), F.lit("\n"), pick("s", "password", "db_password", "PASSWD", "pwd", "auth_token", "secret"), signs("e")), closing, 1),
        (F.concat(pick("p", "AKIA", "ASIA", "AIza"), F.upper(F.substring(letters, 1, 16))), F.concat(pick("s", "aws_access_key_id", "api_key", "ACCESS_KEY", "token"), signs("e")), closing, 1),
        (F.substring(letters, 1, 14), F.concat(pick("s", "password", "client_secret", "DB_PASSWORD", "passphrase"), signs("e")), closing, 1),
        (word("x"), F.concat(word("l"), pick("m", "", " password", " token", " key", " secret"), signs("e")), closing, 0),
        (F.substring(letters, 1, (F.pmod(i, F.lit(7)) + 4).cast("int")), F.concat(word("l"), pick("e", ": ", "=", ":", ' = "', '="', ' "')), pick("r", " ", ". ", ", ", '"'), 0),
        (F.concat(pick("p", "", "2024-", "1."), number("d", 5)), F.concat(word("l"), signs("e")), closing, 0),
        # the name that a value is assigned to
        (F.upper(F.concat_ws("_", F.concat(word("x"), number("v", 1)), word("y"), pick("n", "secret", "token", "key", "value"))), F.concat(word("l"), F.lit("\n")), pick("r", "=", ' = "', ": ", '="', ":"), 0),
    ]
    struct = lambda case: F.struct(case[0].alias("candidate"), case[1].alias("left"), case[2].alias("right"), F.lit(float(case[3])).alias("label"))
    chosen = struct(cases[-1])
    for k, case in reversed(list(enumerate(cases[:-1]))):
        chosen = F.when(kind == k, struct(case)).otherwise(chosen)
    return spark.range(n).coalesce(1).select(chosen.alias("f")).select("f.*")


def fit(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, left, right, label 0 or 1); rows with nulls in candidate or label are passed over.

    The findings are put into one partition in a fixed order, so equal findings give an equal
    forest; they are a bounded set made or labelled by hand.
    """
    rows = described(labelled.where("candidate is not null and label is not null").select("candidate", "left", "right", F.col("label").cast("double").alias("label")))
    rows = rows.coalesce(1).sortWithinPartitions("candidate", "left", "right", "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("vector", "label")
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, nth, candidate, left, right, probability, is_secret for every candidate in docs (doc_id, text).

    Null and empty texts have none; other columns are passed over; repeated rows give their
    findings each. Whole texts are searched.
    """
    model = model or fit(example_findings(docs.sparkSession))
    found = described(findings(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found)
    judged = model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "nth", "candidate", "left", "right", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """scan() with the candidate's digest in place of itself."""
    return scan(docs).select(
        "doc_id", "nth", F.length("candidate").cast("bigint").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.round("probability", 6).alias("probability"), "is_secret",
    )
