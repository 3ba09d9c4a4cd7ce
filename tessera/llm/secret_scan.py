"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are cut out of whole texts with their neighbourhood; a forest over
length, character transitions, dictionary coverage, path and neighbouring
words, trained from labelled findings, scores each. The dictionary is counted
from the corpus itself. All steps are DataFrame expressions and the JVM's own
forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

KEYWORDS = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key"
#: Between a keyword and its value: the key's closing quote, '=', ':', ':=', '==' or '=>', with blanks.
_SEP = r"[\"']?[ \t]{0,8}[=:]{1,2}>?[ \t]{0,8}"
#: One pass finds all candidates: key headers, quoted and unquoted values after a keyword, long runs of key-like characters.
#: An unquoted value ends before a delimiter, or at white space where that would leave less than eight characters.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|(?<=[\"'])(?<=(?i:{KEYWORDS}){_SEP}[\"'])[^\s\"']{{8,}}"
    rf"|(?<=[=:> \t])(?<=[=:]>?[ \t]{{0,8}})(?<=(?i:{KEYWORDS}){_SEP})(?![=:>])(?:[^\s\"',;&(){{}}\[\]<>|]{{8,}}|[^\s\"']{{8,}})"
    r"|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
)
#: Characters of context kept on either side.
CONTEXT = 80
#: Words of placeholders and examples. Fixed values.
PLACEHOLDERS = ["access", "admin", "and", "change", "code", "data", "default", "demo", "dummy", "example", "file", "fake", "foo", "here", "hello", "image", "insert", "key", "name", "none", "null", "page", "pass", "placeholder", "redacted", "sample", "secret", "test", "the", "token", "user", "value", "version", "word", "world", "xxx", "your"]
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/|readme|spec)"
NOT_SECRET = r"(?i)\b(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|build|revision|etag|id|example|sample)\b"
FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "longest_run", "coverage", "placeholder", "test_path", "keyword_before", "assigned", "quoted", "harmless_near", "known_prefix"]
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_OPEN, _CLOSE = "\x01", "\x02"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate of every whole text: id, start (code points), secret, before, after, path."""
    path = F.col(path_col).cast("string") if path_col and path_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.translate(F.col(text_col), _OPEN + _CLOSE, "\x1a\x1a").alias("text"), F.coalesce(path, F.lit("")).alias("path"))
    found = rows.filter(F.rlike("text", F.lit(CANDIDATE)))
    marked = F.split(F.regexp_replace("text", f"({CANDIDATE})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)
    pieces = found.select("id", "path", F.xxhash64("text").alias("row"), F.posexplode(marked).alias("pos", "piece"))
    cut = F.instr("piece", _CLOSE)
    pieces = pieces.select(
        "id", "path", "row", "pos",
        F.when(F.col("pos") > 0, F.substring("piece", F.lit(1), cut - 1)).alias("secret"),
        F.when(F.col("pos") > 0, F.substring("piece", cut + 1, F.length("piece"))).otherwise(F.col("piece")).alias("rest"),
    )
    pieces = pieces.select("id", "path", "row", "pos", "secret", F.left("rest", F.lit(CONTEXT)).alias("after"), F.right(F.concat(F.coalesce("secret", F.lit("")), "rest"), F.lit(CONTEXT)).alias("tail"), (F.length("rest") + F.coalesce(F.length("secret"), F.lit(0))).cast("long").alias("size"))
    # Repeated rows would interleave; they are the same findings, so one of each position is kept and counted.
    pieces = pieces.groupBy("id", "row", "pos").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("path", "secret", "after", "tail", "size")])
    order = Window.partitionBy("id", "row").orderBy("pos")
    placed = pieces.select(
        "id", "path", "secret", "after", "times",
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("start"),
        F.coalesce(F.lag("tail").over(order), F.lit("")).alias("before"),
    )
    return placed.filter(F.col("secret").isNotNull())


def dictionary(df: DataFrame, text_col: str = "text", min_count: int = 20, shortest: int = 4, longest: int = 16) -> DataFrame:
    """The corpus's own words: lower-cased runs of ASCII letters that occur ``min_count`` times or more in all texts together."""
    words = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(shortest, longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).select("word")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def _pieces(secret: Column) -> Column:
    """The letter runs of a value that may be words: camel humps, lower-case and upper-case runs."""
    return F.transform(F.regexp_extract_all(secret, F.lit(r"([A-Z]?[a-z]{3,}|[A-Z]{4,})"), F.lit(1)), F.lower)


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(secret, covered): the letters of each different value that dictionary words cover, by a join on the words."""
    each = found.select("secret").distinct().select("secret", F.explode(_pieces(F.col("secret"))).alias("word"))
    return each.join(words, "word").groupBy("secret").agg(F.sum(F.length("word")).alias("covered")).withColumnRenamed("secret", "__secret")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The forest's columns for rows of secret, before, after and path."""
    covered = coverage(found, words)
    found = found.join(covered, F.col("secret") == F.col("__secret"), "left").drop("__secret")
    s = F.col("secret")
    n = F.length(s)
    kinds = F.regexp_replace(F.translate(s, _LOWER + _UPPER + _DIGIT, "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", "-")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    folded = F.lower(s)
    longest = F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1)), lambda x: F.length(x)))
    flag = lambda c: c.cast("double")
    return found.select(
        *[c for c in found.columns if c != "covered"],
        n.cast("double").alias("length"),
        _share(runs - 1, n - 1).alias("transitions"),
        _share(n - F.length(F.translate(s, _DIGIT, "")), n).alias("digits"),
        _share(n - F.length(F.translate(s, _UPPER, "")), n).alias("uppers"),
        _share(F.size(F.array_distinct(F.split(s, ""))), n).alias("distinct"),
        _share(F.coalesce(longest, F.lit(0)), n).alias("longest_run"),
        _share(F.coalesce("covered", F.lit(0)), n).alias("coverage"),
        _share(n - F.length(F.regexp_replace(folded, "(" + "|".join(PLACEHOLDERS) + ")", "")), n).alias("placeholder"),
        flag(F.rlike("path", F.lit(TEST_PATH))).alias("test_path"),
        flag(F.rlike("before", F.lit(rf"(?i)({KEYWORDS})\b\W{{0,20}}$"))).alias("keyword_before"),
        flag(F.rlike("before", F.lit(r"[=:]>?\s*[\"']?$"))).alias("assigned"),
        flag(F.rlike("before", F.lit(r"[\"']$")) & F.rlike("after", F.lit(r"^[\"']"))).alias("quoted"),
        flag(F.rlike(F.right("before", F.lit(24)), F.lit(NOT_SECRET))).alias("harmless_near"),
        flag(F.rlike(s, F.lit(r"^(AKIA|ASIA|gh[pousr]_|eyJ|xox[abp]-|sk[_-]|-----BEGIN)"))).alias("known_prefix"),
    )


#: Words drawn from the dictionary for findings' prose and harmless values.
DRAWN = 400


def labelled_findings(spark: SparkSession, words: DataFrame, rows: int = 4000, seed: int = 11) -> DataFrame:
    """Labelled findings for training where a team has none of its own: secret, before, after, path, label.

    Values are seeded digests, prose and harmless values are made of the
    corpus's own words: real-looking random values where secrets stand, against
    digests under harmless names, identifiers, paths, placeholders, numbers and
    fixtures. ``rows`` bounds the training set; ``DRAWN`` words come to the driver.
    """
    own = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(DRAWN).collect()] or PLACEHOLDERS
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30))
    pick = lambda k, values: F.element_at(F.split(F.lit("\x01".join(values)), "\x01", -1), (draw(k) % len(values) + 1).cast("int"))
    random_hex = F.sha2(F.concat_ws("-", F.lit(seed), F.col("id")), 256)
    random_64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("+", F.lit(seed), F.col("id")), 512))), "[+/=\\s]", "")
    random_letters = F.translate(random_64, _DIGIT, "qZkVxWjYhP")
    name = pick(1, ["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "TOKEN", "API_KEY", "passwd", "credential", "private_key"])
    assign = pick(2, [' = "', '="', ": '", " = ", "=", ': "', ": ", '": "', " => "])
    word, holder = (lambda k: pick(k, own)), (lambda k: pick(k, PLACEHOLDERS))
    prose = F.concat_ws(" ", word(21), word(22), word(23), word(24))
    named = F.concat(prose, F.lit(" "), pick(30, ["", "", "DB_", "app.", "aws_"]), name, assign)
    loose = F.concat(prose, F.lit(" "))
    good = [
        (F.left(random_hex, pick(31, ["32", "40", "48", "64"]).cast("int")), named),
        (F.upper(F.left(random_hex, F.lit(40))), named),
        (F.left(random_64, 20 + draw(3) % 44), named),
        (F.left(random_64, 8 + draw(3) % 12), named),
        (F.left(random_letters, 16 + draw(3) % 40), named),
        (F.concat(F.left(random_64, 6 + draw(3) % 8), pick(32, ["!", "#", "@9", "$x", "%"]), F.left(random_hex, F.lit(4))), named),
        (F.concat(F.lit("AKIA"), F.upper(F.left(random_hex, F.lit(16)))), loose),
        (F.concat(F.lit("ghp_"), F.left(random_64, F.lit(36))), F.concat(loose, pick(33, ["", "GH=", "export KEY=", '"']))),
        (F.concat(pick(42, ["ghp_", "gho_", "xoxb-", "sk_test_"]), F.left(F.lower(random_64), F.lit(32))), F.concat(loose, pick(43, ["", "GH=", "token ", '"']))),
        (F.concat(F.lit("eyJ"), F.left(random_64, F.lit(60))), F.concat(loose, pick(34, ["Bearer ", "Authorization: ", ""]))),
        (F.concat(F.lit("sk_live_"), F.left(random_64, F.lit(24))), F.concat(loose, pick(35, ["", '"', "key="]))),
    ]
    harmless = pick(4, ["commit ", "sha1: ", "revision ", "checksum = ", "etag: ", "build ", "md5 ", "uuid: ", "hash=", "digest ", "id = ", "sha256:"])
    bad = [
        (F.left(random_hex, pick(31, ["32", "40", "64"]).cast("int")), F.concat(loose, harmless)),
        (F.concat_ws("-", *[F.substring(random_hex, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.concat(loose, pick(36, ["uuid ", "id: ", "", "guid=", "request id "]))),
        (F.concat(word(6), F.lit("-"), word(7), F.lit("-"), word(8), F.lit("-"), (draw(9) % 100).cast("string")), pick(37, ["", "see "])),
        (F.concat(word(6), F.initcap(word(7)), F.initcap(word(8)), F.initcap(word(14))), F.concat(loose, pick(38, ["", "call ", "= ", "return "]))),
        (F.concat(word(6), F.lit("/"), word(7), F.lit("/"), word(8), F.lit("/"), word(14)), F.concat(loose, pick(39, ["", "path: ", "in "]))),
        (F.concat(pick(40, ["your_", "my_", "<", "${", "%"]), holder(6), F.lit("_"), holder(7), F.lit("_here1")), named),
        (F.concat(holder(14), F.lit("_"), holder(15), F.lit("_"), word(16)), named),
        (F.concat(word(14), word(15)), named),
        (F.upper(F.concat(word(14), F.lit("_"), word(15), F.lit("_"), word(16), F.lit("_"), pick(25, ["token", "secret", "access_key"]))), loose),
        (F.repeat(pick(10, ["x", "0", "1", "ab", "12", "*"]), (12 + draw(11) % 10).cast("int")), named),
        (F.concat(draw(12).cast("string"), F.lpad(draw(13).cast("string"), 10, "0")), F.concat(loose, pick(41, ["", "id ", "order ", "phone: "]))),
        (F.concat(word(14), word(15), word(16), (draw(18) % 10).cast("string")), loose),
        (F.repeat(pick(27, ["-", "_", "/", "+"]), (16 + draw(11) % 60).cast("int")), prose),
    ]
    one = lambda options: F.element_at(F.array(*[F.struct(a.cast("string").alias("secret"), b.alias("before")) for a, b in options]), (draw(19) % len(options) + 1).cast("int"))
    label = (F.col("id") % 2).cast("double")
    path = F.when(label == 1, pick(20, ["src/main.py", "config/app.env", "src7", "", "deploy/run.sh"])).otherwise(pick(20, ["tests/fixture.py", "docs/readme.md", "src7", "", "src/main.py", "lib/util.js"]))
    # Secrets and harmless findings are made apart, which keeps the generated code small.
    parts = [spark.range(rows).filter(F.col("id") % 2 == k).select(one(options).alias("f"), prose.alias("prose"), path.alias("path"), label.alias("label")) for k, options in ((1, good), (0, bad))]
    found = parts[0].unionByName(parts[1]).select("f.secret", "f.before", "prose", "path", "label")
    quote = F.when(F.col("before").rlike('"$'), F.lit('" ')).when(F.col("before").rlike("'$"), F.lit("' ")).otherwise(F.lit(" "))
    return found.select("secret", "before", F.concat(quote, "prose").alias("after"), "path", "label")


def train(labelled: DataFrame, words: DataFrame, trees: int = 20, depth: int = 8, max_rows: int = 20_000, seed: int = 7) -> RandomForestClassificationModel:
    """Fit the forest on at most ``max_rows`` labelled findings (the documented bound), chosen by digest.

    ``labelled``: secret, before, after, path, label (1 for a secret). Rows with
    a null secret or label are left out; other nulls are empty.
    """
    rows = labelled.filter(F.col("secret").isNotNull() & F.col("label").isNotNull()).select("secret", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")], "label")
    rows = rows.orderBy(F.xxhash64("secret", "before", "after", "path"), "label").limit(max_rows)
    # Written twice, so that the forest's many passes read a small table instead of making the findings and their features again.
    measured = materialise(features(materialise(rows, "findings"), words), "finding-features")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured)
    # In one partition and one order, for the trees' draws depend on both; the rows are bounded.
    vectors = vectors.coalesce(1).sortWithinPartitions(F.xxhash64("secret", "before", "after", "path"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(vectors)


def secret_scan(df: DataFrame, model: RandomForestClassificationModel, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with its score: id, start, length, secret, score, is_secret, times.

    Defined cases: null and empty texts have no candidates. Repeated rows (equal
    id and text) give each finding once, with the number of rows in ``times``.
    Null ids and paths are carried as null and empty. The control characters
    U+0001 and U+0002 are read as U+001A. Very long texts are searched whole,
    and a run may be as long as its text. An empty table gives no rows. Other
    columns are ignored. ``words``: the dictionary, of one column ``word``.
    """
    found = features(candidates(df, id_col, text_col, path_col), words)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "start", F.length("secret").cast("long").alias("length"), "secret", score.alias("score"), (score >= threshold).alias("is_secret"), "times")
