"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters with a digit or mixed case in it, or a value of six or
more characters that a word such as "password" assigns, all digits only where it is a password, or the
password of a login in an address; a word may hold several.
Its features are its length, the transitions between
character classes, how much of it common words cover, whether it looks like a path, address or
identifier, whether it begins as issued keys do, and which words stand around it. The forest is trained by Spark's own learner from
labelled findings; ``labelled_findings`` makes a bounded set of them by rule, and any other table of
(text, label) pairs with one candidate each can take its place. The trees are then compiled into
one expression, so that scanning, scoring and redaction are one pass over each row without a join,
a shuffle or Python.

Defined cases: null and empty texts have no findings and stay as they are; a value that occurs twice
is two findings; repeated rows get repeated results; an empty table gives an empty result; columns
other than the id and the text are not read by the scan and are passed on unchanged by redaction.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import let, table

MIN_RUN = 16
MIN_ASSIGNED = 6
TREES = 24
DEPTH = 8
CUTOFF = 0.5
NEAR_WORDS = 3
MASK = "<secret>"
SEED = 17
#: Characters that keys, tokens and encoded data are made of.
RUN = r"[A-Za-z0-9+/_=.~\-]"
NAMED = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api_?key|credential)s?[\"']?"
ASSIGNED = NAMED + r"\s*[:=]\s*[\"']?"
PASSWORD = r"(?i)(?:passw|pwd)"
#: A login in an address, its password as the group.
LOGIN = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]*:([^\s/@]{6,})@"
#: An assigned value: up to its quote, or else up to a delimiter; "&" is one only before the next name of a URL's query.
VALUE = r"(?:(?<=\")(?!<)[^\s\"]{6,}|(?<=')(?!<)[^\s']{6,}|(?:[^\s\"'`,;&<>]|&(?![A-Za-z_][\w.\-]*=)){6,})"
#: Fixed lists: words of code, paths and prose that keys don't hold; words that announce a secret or an example.
DICTIONARY = (
    "admin account address article assets backup build bucket button cache class client cloud common config content control country "
    "data database default define delete description document domain download element error event example export false file filter "
    "folder format function global group handler header html http image import index input install item java language library "
    "license list local login main manager master message method model module name number object option order output package "
    "page param parent path people point port process product profile project property public query record release remote report "
    "request resource response result return root schema screen script search section select server service session setting source "
    "static status storage stream string style sub system table target task template test text title true type update upload user "
    "util value version view web window word work world"
).split()
ANNOUNCE = "token secret password passwd pwd key apikey api_key credential auth bearer private access signature".split()
EXAMPLES = "example sample dummy placeholder changeme your test fake xxxx todo sha1 sha256 sha512 md5 checksum digest commit revision uuid guid hash etag version build".split()
#: Fixed list: how keys begin that services issue.
PREFIXES = (
    "AKIA", "ASIA", "AIza", "ya29.", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "sk-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-",
    "npm_", "pypi-", "hf_", "SG.", "shpat_", "dop_v1_", "dckr_pat_",
)
FEATURES = (
    "length", "transitions", "digits", "upper", "lower", "vowels", "longest_letters", "consonants", "entropy", "distinct", "covered",
    "slashes", "dots", "dashes", "underscores", "uuid", "address", "extension", "hex", "announced", "example", "assigned", "quoted",
    "prefixed", "login",
)


def _words(listed: list[str]) -> str:
    """Pattern of these words as words or parts of identifiers: no letter stands beside them ("test", not "latest")."""
    return r"(?<![a-z])(?:" + "|".join(listed) + r")s?(?![a-z])"


def _share(value: Column, pattern: str) -> Column:
    """Share of the value's characters that a class of characters holds."""
    return F.char_length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.greatest(F.char_length(value), F.lit(1))


def _longest(value: Column, pattern: str) -> Column:
    runs = F.regexp_extract_all(value, F.lit(f"[{pattern}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0)).cast("double")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def features(c: Column) -> dict[str, Column]:
    """Features of one candidate struct (value, part, before, after)."""
    value, around = c["value"], F.lower(F.concat_ws(" ", c["before"], c["part"], c["after"]))
    length = F.char_length(value)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "\u0001"), "[A-Z]", "\u0002"), "[a-z]", "\u0003")
    runs = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    chars = F.filter(F.split(value, ""), lambda x: x != "")
    share = lambda ch, every: F.size(F.filter(every, lambda x: x == ch)) / F.size(every)
    entropy = let(
        chars, lambda every: F.aggregate(F.array_distinct(every), F.lit(0.0), lambda t, ch: t - share(ch, every) * F.log2(share(ch, every)))
    )
    bare = F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")
    return {
        "length": length.cast("double"),
        "transitions": (runs - 1) / F.greatest(length - 1, F.lit(1)),
        "digits": _share(value, "0-9"),
        "upper": _share(value, "A-Z"),
        "lower": _share(value, "a-z"),
        "vowels": _share(F.lower(value), "aeiou"),
        "longest_letters": _longest(value, "A-Za-z"),
        "consonants": _longest(F.lower(value), "b-df-hj-np-tv-z"),
        "entropy": entropy,
        "distinct": F.size(F.array_distinct(chars)) / F.greatest(length, F.lit(1)),
        "covered": F.lit(1.0) - F.char_length(bare) / F.greatest(length, F.lit(1)),
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
        "dots": F.regexp_count(value, F.lit(r"\.")).cast("double"),
        "dashes": F.regexp_count(value, F.lit("-")).cast("double"),
        "underscores": F.regexp_count(value, F.lit("_")).cast("double"),
        "uuid": _flag(F.lower(value).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "address": _flag(F.lower(c["part"]).rlike(r"https?:|www\.|@|\.(?:com|org|net|io|example)\b")),
        "extension": _flag(F.lower(value).rlike(r"\.[a-z]{1,4}[0-9]?$")),
        "hex": _flag(F.lower(value).rlike("^(?:0x)?[0-9a-f]+$")),
        "announced": _flag(around.rlike(_words(ANNOUNCE))),
        "example": _flag(F.regexp_replace(around, r"\S*@\S*|https?://\S*", " ").rlike(_words(EXAMPLES))),
        "assigned": _flag(F.concat_ws(" ", c["before"], c["part"]).rlike(r"(?i)(?:" + "|".join(ANNOUNCE) + r")[a-z_]*[\"']?\s*[:=]")),
        "quoted": _flag(c["part"].rlike("[\"'`]")),
        "prefixed": _flag(value.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")")),
        "login": _flag(c["part"].rlike("^" + LOGIN)),
    }


def candidates(text: Column) -> Column:
    """Array of (position, word, part, value, before, after); position counts white-space words from 0.

    A word gives every value that is assigned in it or by the two words before it, then every run in
    what is left of it. ``part`` is the assignment, or the word for a run.
    """
    whole = F.coalesce(text, F.lit(""))
    worth_it = whole.rlike(f"{RUN}{{{MIN_RUN},}}") | whole.rlike(ASSIGNED + VALUE) | whole.rlike(LOGIN)
    words = F.split(F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")), " ")
    row = "array<struct<position:int,word:string,part:string,value:string,assigned:boolean>>"

    def near(every: Column, low: Column, high: Column) -> Column:
        start = F.greatest(low, F.lit(0))
        return F.array_join(F.slice(every, start + 1, F.greatest(F.least(high, F.size(every)) - start, F.lit(0))), " ")

    def in_word(w: Column, i: Column, led: Column) -> Column:
        def one(part: Column, value: Column, assigned: bool) -> Column:
            return F.struct(i.alias("position"), w.alias("word"), part.alias("part"), value.alias("value"), F.lit(assigned).alias("assigned"))

        def assigned(part: Column, value: Column) -> Column:
            bare = F.when(part.rlike(r"[:=]\s*[\"']"), value).otherwise(F.regexp_replace(value, r"[.:)\]}]+$", ""))
            return one(part, F.regexp_replace(bare, r"^[=.\-]+", ""), True)

        logins = F.zip_with(F.regexp_extract_all(led, F.lit(LOGIN), F.lit(0)), F.regexp_extract_all(led, F.lit(LOGIN), F.lit(1)), assigned)
        other = F.regexp_replace(led, LOGIN, " ")
        values = F.zip_with(F.regexp_extract_all(other, F.lit(ASSIGNED + VALUE), F.lit(0)), F.regexp_extract_all(other, F.lit(f"{ASSIGNED}({VALUE})"), F.lit(1)), assigned)
        runs = F.regexp_extract_all(F.regexp_replace(other, ASSIGNED + VALUE, " "), F.lit(f"{RUN}{{{MIN_RUN},}}"), F.lit(0))
        return F.concat(F.filter(F.concat(logins, values), lambda r: F.char_length(r["value"]) >= MIN_ASSIGNED), F.transform(runs, lambda v: one(w, v, False)))

    def found(every: Column) -> Column:
        def led(w: Column, i: Column) -> Column:
            """The word, after a stand-in for the assignment that the words before it begin."""
            return let(
                near(every, i - 2, i),
                lambda before: F.concat(
                    F.when(before.rlike(ASSIGNED + "$"), F.concat(name(before), F.lit("="))).when(before.rlike(NAMED + "$") & w.rlike("^[:=]"), name(before)).otherwise(""), w),
            )

        def name(before: Column) -> Column:
            return F.when(before.rlike(PASSWORD + r"\S*\s*[:=]?\s*[\"']?$"), "pwd").otherwise("token")

        rows = F.flatten(F.transform(every, lambda w, i: F.when(F.char_length(w) >= MIN_ASSIGNED, let(led(w, i), lambda x: in_word(w, i, x).cast(row))).otherwise(F.array().cast(row))))
        # Prose has long words too: a candidate holds a digit, an inner capital or a sign, or is assigned.
        kept = F.filter(rows, lambda r: r["assigned"] | r["value"].rlike("[0-9+/_=~]|[a-z][A-Z]"))
        kept = F.filter(kept, lambda r: ~r["value"].rlike(r"^(.)\1*$|^[0-9.\-]+$") | (r["assigned"] & r["part"].rlike(PASSWORD) & r["value"].rlike("^[0-9]+$") & ~r["value"].rlike(r"^(.)\1*$")))
        return F.transform(
            kept,
            lambda r: F.struct(
                r["position"].alias("position"), r["word"].alias("word"), r["part"].alias("part"),
                F.when(r["assigned"], r["value"]).otherwise(F.regexp_replace(r["value"], r"^[=.\-]+|[.\-]+$", "")).alias("value"),
                near(every, r["position"] - NEAR_WORDS, r["position"]).alias("before"), near(every, r["position"] + 1, r["position"] + 3).alias("after"),
            ),
        )

    return F.when(worth_it, let(words, found))


class Forest:
    """A fitted forest as nested (feature, threshold, left, right) tuples with shares as leaves."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, labelled: DataFrame) -> Forest:
        """Train on (text, label): the first candidate of each text; labels are 0 and 1."""
        rows = labelled.select(F.get(candidates(F.col("text")), F.lit(0)).alias("c"), F.col("label").cast("double")).filter("c is not null")
        rows = rows.select("label", *[v.alias(k) for k, v in features(F.col("c")).items()])
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        learner = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, cacheNodeIds=False)
        return cls([cls._read(t.rootNode()) for t in learner.fit(ready)._java_obj.trees()])

    @classmethod
    def _read(cls, node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / (sum(stats) or 1.0)
        split = node.split()
        return split.featureIndex(), split.threshold(), cls._read(node.leftChild()), cls._read(node.rightChild())

    def column(self, values: dict[str, Column] | Column) -> Column:
        """Mean of the trees' shares, as one expression."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(values[FEATURES[feature]] <= threshold, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walk(tree)
        return total / F.lit(float(max(len(self.trees), 1)))


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = SEED) -> DataFrame:
    """A bounded table of (text, label) made by rule: real-looking secrets and look-alikes in context."""
    rng = random.Random(seed)
    letters, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    syllables = "ver ung keit lich schaft tion ment able ing est ous ción mente eau tre oir que pro con der ent ist".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    compound = lambda n: "".join(rng.choices(syllables, k=n))
    name = lambda sep: sep.join(rng.choices(DICTIONARY, k=rng.randint(3, 5)))
    positive = [
        *[lambda: pick("0123456789abcdef", rng.choice((32, 40, 48, 64)))] * 2,
        lambda: pick(letters + "0123456789", rng.randint(20, 44)),
        lambda: pick(letters + "0123456789+/", rng.choice((40, 64))) + "=" * rng.randint(0, 2),
        lambda: "AKIA" + pick(letters[:26] + "0123456789", 16),
        lambda: rng.choice(("ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_", "AIza")) + pick(letters + "0123456789", 36),
        lambda: ".".join(("eyJ" + pick(letters + "0123456789_-", 30), pick(letters + "0123456789_-", 60), pick(letters + "0123456789_-", 43))),
        lambda: pick(letters, 4) + pick("0123456789", 3) + pick("+/_~", 1) + pick(letters + "0123456789", 6),
        lambda: pick(letters, rng.randint(3, 6)) + pick("!@#%^&*$", rng.randint(1, 2)) + pick(letters + "0123456789!@#%^&", rng.randint(3, 8)),
        lambda: "".join(rng.choices((*DICTIONARY, *syllables), k=rng.randint(4, 6))),
    ]
    #: Values that tell themselves: they are secrets wherever they stand.
    plain = [
        positive[4], positive[5], positive[5], positive[6],
        lambda: rng.choice(PREFIXES[5:]) + pick(letters + "0123456789", rng.choice((20, 24, 32, 36))),
        lambda: rng.choice(("xoxb-", "xoxp-")) + pick("0123456789", 12) + "-" + pick("0123456789", 12) + "-" + pick(letters + "0123456789", 24),
        lambda: pick(letters + "0123456789", rng.randint(32, 48)),
    ]
    login = lambda word: rng.choice(("postgres", "mysql", "mongodb", "https", "redis", "amqp")) + "://" + compound(2) + ":" + word + "@" + compound(2) + rng.choice(("", ".com", ":5432")) + "/" + compound(1)
    neutral = ("{}", "see {}", "use {} here", "({})", "\"{}\"", "{},", "with {} set", "key: {}")
    announce = ["token = \"{}\"", "api_key: {}", "secret={}", "password = '{}'", "export AUTH_TOKEN={}", "Authorization: Bearer {}", "access_key = \"{}\"", "\"private_key\": \"{}\"", "pwd={}"]
    negative = [
        lambda: name("/") + rng.choice((".html", ".py", ".png", "/" + str(rng.randint(1, 99)))),
        lambda: name("_") + str(rng.randint(1, 9)),
        lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: "https://" + compound(3) + ".com/" + name("/"),
        lambda: "".join(w.capitalize() for w in rng.choices(DICTIONARY, k=4)) + rng.choice(("", "2", "V1")),
        lambda: compound(5) + "_" + compound(3),
        lambda: "v" + ".".join(str(rng.randint(0, 30)) for _ in range(3)) + "-release-build" + str(rng.randint(1, 500)),
        lambda: compound(6) + "/" + compound(4),
        lambda: "=" * rng.randint(3, 9) + compound(5) + "=" * rng.randint(3, 9),
        lambda: pick("0123456789", 8) + "_" + compound(4),
        lambda: rng.choice(("order-", "IMG_", "ref-", "scan_")) + pick("0123456789", 8) + rng.choice("-_") + pick("0123456789", rng.randint(6, 9)),
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
    ]
    hashes = ["sha256: {}", "commit {}", "md5 checksum {}", "etag {}", "revision {}", "sample token = {} example"]
    made = []
    for i in range(rows):
        if i % 2:
            value, frame, label = rng.choice(positive)(), rng.choice(announce), 1
            kind = rng.random()
            if kind < 0.28:
                value, frame = rng.choice(plain)(), rng.choice(neutral)
            elif kind < 0.34:
                value, frame = login(rng.choice((pick(letters + "0123456789", rng.randint(8, 20)), compound(2) + pick(letters + "0123456789", 8)))), rng.choice(neutral)
            elif kind < 0.38:
                value, frame = pick("123456789", 1) + pick("0123456789", rng.randint(5, 9)), rng.choice(("pwd={}", "password: {}", "passwd = \"{}\""))
        else:
            value, label = rng.choice(negative)(), 0
            frame = rng.choice(("{}", "see {}", "\"{}\"", "file = {}", "key: {}", "path {}"))
            if rng.random() < 0.3:
                value, frame = pick("0123456789abcdef", rng.choice((32, 40, 64))), rng.choice(hashes)
            elif rng.random() < 0.2:
                value, frame = rng.choice(("YOUR_API_KEY_HERE", "xxxxxxxxxxxxxxxxxxxx1", "changeme_please_123", "example_token_value_1", "<placeholder_token_1>", rng.choice(DICTIONARY), compound(2))), rng.choice(announce)
            elif rng.random() < 0.08:
                value, frame = login(rng.choice(("password", "changeme", "your_password", "<password>", "example", "secret_here", "PASSWORD"))), rng.choice(neutral)
        text = f"{prose(4)} {frame.format(value)} {prose(3)}"
        made.append((text.upper() if rng.random() < 0.05 else text, label))
    return spark.createDataFrame(made, "text string, label int")


def findings(text: Column, forest: Forest, cutoff: float = CUTOFF) -> Column:
    """Array of (position, value, score, is_secret) of one text; null without candidates."""
    scored = lambda c: let(F.struct(*[v.alias(k) for k, v in features(c).items()]), forest.column)
    rows = F.transform(
        candidates(text), lambda c: F.struct(c["position"].alias("position"), c["value"].alias("value"), scored(c).alias("score"))
    )
    return F.transform(
        rows,
        lambda r: F.struct(r["position"].alias("position"), r["value"].alias("value"), r["score"].alias("score"), (r["score"] >= cutoff).alias("is_secret")),
    )


def scan_secrets(docs: DataFrame, forest: Forest, *, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, position, value, score and is_secret: a row for every candidate."""
    found = docs.select("doc_id", F.explode(findings(F.col(text), forest, cutoff)).alias("f"))
    return found.select("doc_id", "f.position", "f.value", "f.score", "f.is_secret")


def redact_secrets(docs: DataFrame, forest: Forest, *, text: str = "text", cutoff: float = CUTOFF, mask: str = MASK) -> DataFrame:
    """The same rows and columns with every secret's characters replaced in the text."""
    secrets = F.transform(F.filter(findings(F.col(text), forest, cutoff), lambda f: f["is_secret"]), lambda f: f["value"])
    longest = F.array_sort(F.array_distinct(secrets), lambda a, b: F.char_length(b) - F.char_length(a))
    clean = F.aggregate(longest, F.col(text), lambda t, v: F.replace(t, v, F.lit(mask)))
    return docs.withColumn(text, F.coalesce(clean, F.col(text)))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), Forest.fit(labelled_findings(spark)))
