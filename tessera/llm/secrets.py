"""Secret scanning: candidates by shape, false positives removed by a random forest.

Candidates are runs of 16 or more characters of keys and tokens with a digit among them, runs of 20 or more without one
that mix small letters and capitals, and whatever of 8 or more characters stands after a name such as "password" and a sign
of assignment, digits or not. Shorter ones are not looked at. Features are their length, character classes and transitions, how much of them dictionary words cover, whether they stand in a path, and the words
beside them. The forest is trained by Spark on a bounded, generated table of labelled findings and then written out as
Column expressions, so scanning is one pass of built-in expressions over all texts.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import doc_text

CHARS = r"A-Za-z0-9+/_\-"
NAMES = "passw(?:or)?d|passphrase|pwd|secret|token|api.?key|access.?key|credential"
CANDIDATE = (
    rf"(?<![{CHARS}])(?:(?=[A-Za-z+/_\-]*[0-9])[{CHARS}]{{16,}}={{0,2}}|(?=[A-Z+/_\-]*[a-z][a-z+/_\-]*[A-Z])[{CHARS}]{{20,}}={{0,2}})"
    rf"|(?<=[\s:=\"'`])(?<=(?i:{NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"'`]?)[^\s\"'`,;<>:=][^\s\"'`,;<>]{{7,}}"
)
#: What every text with a candidate has: a long run, or a name before a sign of assignment. Cheaper than looking for candidates.
HINT = rf"[{CHARS}]{{16}}|(?i:{NAMES})[\"']?\s{{0,2}}[:=]"
BEFORE, AFTER = 48, 16
# Words and word parts that names, paths and prose are made of.
DICTIONARY = (
    "able about account address after again all and answer any app are article back base before best between block body book build but cache call can case "
    "change check city class client close code column comment company config content copy count country create data date day default delete detail digest do "
    "document down draft each edit email end entry error event example file filter final find first flag for form format from full group hash have head help "
    "high home host image index info input into item job json key label last left length level library like line link list load local log long mail main make "
    "map mark max menu message min mode model month more name new next node not note number object of old one open option order other out output page part "
    "path people photo place plan point post print product profile project public query read record release report result right root row run sample save "
    "script search section send series server service session set shop show side site size sort source start state static status step store string style "
    "system table tag task team temp test text that the this time title type update upload url use user value version video view web when width with word "
    "work world write year"
).split()


@dataclass(frozen=True)
class Forest:
    """labelled: rows of the generated training table, the bound of the sample."""

    labelled: int = 4000
    trees: int = 16
    depth: int = 6
    seed: int = 5
    least: float = 0.5


def feature_columns(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's features of candidate c between before and after."""
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda text, pattern: F.coalesce(text.rlike(pattern), F.lit(False)).cast("double")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))
    low, low_before = F.lower(c), F.lower(before)
    border = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[+/_\-])"
    return {
        "length": F.least(n, F.lit(200)).cast("double"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "marks": share(r"[+/_\-=]"),
        "transitions": F.regexp_count(c, F.lit(border)) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "dictionary": (n - F.length(F.regexp_replace(low, f"(?:{words})", ""))) / n,
        "hex": flag(low, "^[0-9a-f]+$"),
        "uuid": flag(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "prefix": flag(c, r"^(?:AKIA|ASIA|gh[opsu]_|xox[abp]-|sk[-_]|pk[-_]|eyJ|AIza|glpat-|npm_)"),
        "path": F.greatest(flag(before, r"(?:https?:|[\w.]/|\\|/)\S*$"), flag(after, r"^[/?#@]|^\.[a-z]{2,4}\b"), (F.regexp_count(c, F.lit("/")) >= 3).cast("double")),
        "secret_word": flag(low_before, r"(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|key)\W{0,6}$"),
        "plain_shape": flag(low, r"^[a-z]+(?:[_.][a-z]+)*[_.]?\(?\)?$|^[*x]+$"),
        "plain_word": flag(low_before, r"(?:sha\d*|md5|commit|checksum|digest|hash|uuid|guid|id|version|build|rev(?:ision)?|etag|isbn|order|invoice|file|image|base64)\W{0,6}$"),
        "assigned": flag(before, r"[=:]\s*[\"'`]?$"),
        "quoted": flag(before, r"[\"'`]$"),
    }


FEATURES = tuple("length digits capitals marks transitions variety dictionary hex uuid prefix path secret_word plain_shape plain_word assigned quoted".split())


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label) by rules: secrets as they stand in configurations and prose, and what looks like them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = lambda k, sep="": sep.join(r.choice(DICTIONARY) for _ in range(k))
    prose = lambda: " ".join(pick("etaoinshrdlu", r.randint(2, 8)) for _ in range(3)) + " "

    def secret() -> tuple[str, str]:
        name = r.choice(("token", "secret", "password", "api_key", "apikey", "access_key", "auth", "private key", "client_secret", "key", "Bearer", "credential"))
        name = name.upper() if r.random() < 0.25 else name
        sign = r.choice((" = \"", "=\"", ": ", ":", "=", " = '", " "))
        body = r.choice((lambda: pick(hexa, r.choice((32, 40, 40, 64))), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(b64, 40), lambda: pick(hexa.upper(), 40)))()
        if r.random() < 0.25:  # passwords and passphrases, digits or not
            name = r.choice(("password", "passwd", "pwd", "passphrase", "secret", "token", "PASSWORD", "Passphrase"))
            sign = r.choice((" = \"", "=\"", ": ", "=", " = '"))
            body = r.choice((lambda: pick(string.ascii_letters + "!#$%&*?.", r.randint(9, 20)), lambda: words(3, r.choice(".-_!")).title() + r.choice("!#$%"), lambda: pick(string.ascii_letters, r.randint(12, 24))))()
            return prose() + name + sign, body
        if r.random() < 0.3:
            body = r.choice(("AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 40), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)))
            if r.random() < 0.3:
                return prose(), body
        return prose() + name + sign, body

    def plain() -> tuple[str, str]:
        kind = r.randrange(12)
        if kind >= 10:  # names in prose and code
            before = prose() + r.choice(("password: ", "token = ", "secret: ", "pwd=", "password = "))
            return r.choice(((before, r.choice(("required", "optional", "undefined", "String(", "process.env", "getToken()", "<password>", "changeme", "********", "xxxxxxxx", "password"))), (prose(), "".join(w.title() for w in words(r.randint(4, 6), " ").split())), (before, words(2, "_"))))
        if kind == 0:
            return prose() + r.choice(("commit ", "sha256:", "md5 ", "checksum: ", "digest=", "hash ", "etag: \"")), pick(hexa, r.choice((32, 40, 64)))
        if kind == 1:
            return prose() + r.choice(("id ", "uuid: ", "guid=", "", "(")), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return prose() + r.choice(("", "order ", "invoice: ", "id=")), pick(string.digits, r.randint(16, 24))
        if kind == 3:
            return prose() + r.choice(("", "file ", "= \"", "name: ")), words(r.randint(2, 4), r.choice("_-")) + r.choice("_-") + str(r.randint(1, 2025))
        if kind == 4:
            return prose() + r.choice(("https://example.com/", "/usr/local/", "http://a.example/x/", "../")), words(2, "/") + "/" + str(r.randint(10, 99999)) + "-" + words(2, "-")
        if kind == 5:
            return prose() + r.choice(("", "class ", "call ")), "".join(w.title() for w in words(r.randint(3, 5), " ").split()) + str(r.randint(0, 99))
        if kind == 6:
            return prose() + "data:image/png;base64,", pick(b64, r.randint(40, 160))
        if kind == 7:
            return prose() + r.choice(("", "on ", "date: ")), f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{words(1)}-{r.randint(100, 999)}"
        if kind == 8:
            return prose() + r.choice(("token = \"", "password: ", "key=", "secret: ")), r.choice(("your", "my", "sample", "example", "test")) + "_" + words(2, "_") + "_" + r.choice(("here1", "123", "000", "1234"))
        return prose(), pick("etaoinshrdlu", r.randint(10, 16)) + pick(string.digits, r.randint(1, 6)) + pick("etaoinshrdlu", r.randint(2, 8))

    out = []
    for i in range(n):
        label = i % 2
        before, body = (secret if label else plain)()
        close = "\"" if before.endswith("\"") else "'" if before.endswith("'") else ""
        out.append((before[-BEFORE:], body, close + r.choice((" ", ".", "\n", " and", ",")), label))
    return out


def _tree(lines: list[str]) -> Callable[[dict[str, Column]], Column]:
    """A tree from the lines of its debug string."""
    head = lines.pop(0).strip()
    if m := re.match(r"Predict: ([\d.]+)", head):
        value = float(m[1])
        return lambda f: F.lit(value)
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", head)
    name, border = FEATURES[int(m[1])], float(m[2])
    left = _tree(lines)
    lines.pop(0)  # Else
    right = _tree(lines)
    return lambda f: F.when(f[name] <= border, left(f)).otherwise(right(f))


def train_forest(spark: SparkSession, params: Forest) -> list[Callable[[dict[str, Column]], Column]]:
    """The trees, each a function from features to its vote."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame(labelled_findings(params.labelled, params.seed), "before string, candidate string, after string, label int")
    own = feature_columns(F.col("candidate"), F.col("before"), F.col("after"))
    table = rows.select(*[own[f].cast("double").alias(f) for f in FEATURES], F.col("label").cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, seed=params.seed, maxBins=64).fit(vectors.select("features", "label"))
    return [_tree(tree.toDebugString.splitlines()[1:]) for tree in model.trees]


_FORESTS: dict[Forest, list] = {}


def _trained(spark: SparkSession, params: Forest) -> list[Callable[[dict[str, Column]], Column]]:
    """Of this process: the training table and the forest depend on params alone, so they are made once."""
    if params not in _FORESTS:
        _FORESTS[params] = train_forest(spark, params)
    return _FORESTS[params]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal (of the candidate in the text), candidate, before, after."""
    # Texts without candidates give no rows; a filter on their number would have them looked for twice.
    df = docs.select(F.col(id_col), doc_text(text_col).alias("_t")).filter(F.col("_t").rlike(HINT))
    df = df.select(id_col, F.regexp_extract_all("_t", F.lit(CANDIDATE), 0).alias("_c"), F.split("_t", CANDIDATE, -1).alias("_p"))
    ends = F.transform("_c", lambda c, i: F.struct(i.alias("ordinal"), c.alias("candidate"), F.right(F.get("_p", i), F.lit(BEFORE)).alias("before"), F.left(F.get("_p", i + 1), F.lit(AFTER)).alias("after")))
    return df.select(id_col, F.explode(ends).alias("x")).select(id_col, "x.*")


def scan_secrets(docs: DataFrame, params: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each candidate of each row of docs: doc_id, ordinal, candidate, its neighbours, features, score (share of trees), is_secret.

    A null or empty text has no candidates. Rows that repeat an id are scanned each by itself. Other columns are
    ignored; an empty table gives an empty one.
    """
    params = params or Forest()
    trees = _trained(docs.sparkSession, params)
    found = candidates(docs, id_col, text_col)
    own = feature_columns(F.col("candidate"), F.col("before"), F.col("after"))
    found = found.withColumns({f"f_{f}": own[f].cast("double") for f in FEATURES})
    at = {f: F.col(f"f_{f}") for f in FEATURES}
    score = sum((t(at) for t in trees[1:]), trees[0](at)) / len(trees)
    return found.withColumn("score", score).withColumn("is_secret", F.col("score") >= params.least)
