"""Secret scan: candidates by pattern, false positives removed by a random forest compiled into Spark expressions. Native."""

from __future__ import annotations

import json
import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import let, lowest
from folioforge.llm.trees import forest, tree_column

_KEYS = r"(?i:pass(?:wor|w|phrase|co)?d?e?|pwd|secret(?:[_\- ]?(?:access[_\- ]?)?key)?|(?:api|access|private|auth|account|encryption|signing|client)[_\- ]?(?:key|secret|token)|token|credentials?|auth)"
_SIGN = r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}"
_KNOWN = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_\-]{30,}+|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]*+)?"

# What may be a secret: a private key's block; the password of a url; what is assigned to a telling word, of 6 characters or
# more; a token of a known form; a run of 16 or more token characters that holds a digit.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s:,]*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?"
    r"|://[^\s/@:\"']{0,64}:[^\s/@\"']{3,200}(?=@)"
    r"|" + _KEYS + _SIGN + r"(?:\"[^\"\n]{6,200}(?=\")|'[^'\n]{6,200}(?=')|[^\s\"'<>]{5,}[^\s\"'<>.,;:)\]}])"
    r"|(?i:bearer)\s{1,3}[A-Za-z0-9._~+/\-]{12,}+={0,2}"
    r"|(?<![A-Za-z0-9])(?:" + _KNOWN + r")(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
)
_LEAD = r"(?s)^((?:://[^:]*:|" + _KEYS + _SIGN + r"[\"']?|(?i:bearer)\s{1,3})?)(.*)$"  # what stands before the value in a match

# Words that ordinary identifiers and paths are made of.
DICTIONARY = (
    "account admin api app archive asset auth backup batch bin branch build cache case channel class client code commit common config content copy core count customer data date default demo dev device doc "
    "document draft dummy error event example export file final flag folder form group guide header home host image import index info input invoice item job key lib line link list local log mail main "
    "manual media message model module month name new node note number object old order output package page part password path placeholder post press prod product project public queue record release "
    "report request resource response result role root sample script section secret server service session setting share site source staging start state static status step store stream string style "
    "summary system table tag target task team temp template test text thread ticket time title token topic train type unit update upload user usr value var version video view week work world year your"
).split()
# What documentation and messages put behind telling words.
ASSIGNED = (
    "required", "string", "optional", "invalid", "expired", "undefined", "unknown", "incorrect", "missing", "none given", "boolean", "varchar", "disabled", "protected", "forgotten", "everything", "nothing", "something", "whatever",
    "because", "because of this", "enter your password", "not found here", "please try again", "the following", "session", "account", "refreshed",
)
BEFORE = 48  # characters before a candidate that count as its neighbours
AFTER = 16


def _transitions() -> list[float]:
    """Logarithms of the chance that a character follows another in the dictionary's words, by 28 x first + second: a to z, digits, others."""
    counts = np.full((28, 28), 0.1)
    for word in DICTIONARY:
        for x, y in zip(word, word[1:], strict=False):
            counts[ord(x) - 97, ord(y) - 97] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True)).round(4).ravel().tolist()


_FOUND = "array<struct<lead:string,value:string,start:int,before:string,after:string>>"


def _sums_before(lengths: Column) -> Column:
    """For every element the sum of those before it, by blocks of the root of their number, so that many cost little more each than few."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def blocked(x: Column, block: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, block)))
        offsets = let(sums, lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda b: total(F.slice(t, F.lit(1), b - 1))))
        own = lambda o: F.transform(x, lambda _, i: F.element_at(o, F.floor(i / block).cast("int") + 1) + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, F.pmod(i, block))))
        return let(offsets, own)

    return let(lengths, lambda x: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int")), lambda block: blocked(x, block)))


def parsed(text: Column) -> Column:
    """struct<found: array<struct<lead, value, start, before, after>>, rest>: a text's candidates; lead is the text from the one before to it, rest what follows the last.

    start counts characters from 0. Null is an empty text.
    """

    def of(t: Column) -> Column:
        def placed(matches: Column) -> Column:
            def rows(pieces: Column) -> Column:
                steps = F.sequence(F.lit(1), F.size(matches))
                begin = _sums_before(F.transform(steps, lambda i: F.length(F.element_at(pieces, i)) + F.length(F.element_at(matches, i))))

                def made(s: Column) -> Column:
                    def row(i: Column) -> Column:
                        match = F.element_at(matches, i)
                        lead = F.concat(F.element_at(pieces, i), F.regexp_extract(match, _LEAD, 1))
                        return let(lead, lambda x: F.struct(x.alias("lead"), F.regexp_extract(match, _LEAD, 2).alias("value"), (F.element_at(s, i) + F.length(x)).alias("start"), F.right(x, F.lit(BEFORE)).alias("before"), F.left(F.element_at(pieces, i + 1), F.lit(AFTER)).alias("after")))

                    return F.struct(F.transform(steps, row).alias("found"), F.element_at(pieces, -1).alias("rest"))

                return let(begin, made)

            return F.when(F.size(matches) > 0, let(F.split(t, CANDIDATE, -1), rows)).otherwise(F.struct(F.array().cast(_FOUND).alias("found"), t.alias("rest")))

        return let(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), placed)

    return let(F.coalesce(text, F.lit("")), of)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs for a candidate and its neighbours, as doubles."""
    n = F.length(value).cast("double")
    low, near = F.lower(value), F.lower(before)
    share = lambda pattern, c=value: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    table = F.array(*[F.lit(x) for x in _transitions()])
    code = lambda ch: F.when(ch.between("a", "z"), F.ascii(ch) - 97).when(ch.between("0", "9"), 26).otherwise(27)
    chance = let(
        F.transform(F.split(low, ""), code),
        lambda c: F.when(F.size(c) > 1, F.aggregate(F.sequence(F.lit(2), F.size(c)), F.lit(0.0), lambda acc, i: acc + F.element_at(table, F.element_at(c, i - 1) * 28 + F.element_at(c, i) + 1)) / (F.size(c) - 1)).otherwise(0.0),
    )
    return [
        n,
        chance,  # mean transition
        share(r"[0-9]"), share(r"[A-Z]"), share(r"[a-z]"), share(r"[+/_\-=]"), share(r"[^A-Za-z0-9+/_\-=\s]"), share(r"\s"),
        share(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),  # transitions between letters and digits
        share(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),  # and between cases
        F.size(F.array_distinct(F.split(value, ""))) / n,
        flag(low.rlike(r"^[0-9a-f]+$")), flag(value.rlike(r"^[0-9]+$")),
        (n - F.length(F.regexp_replace(low, words, ""))) / n,  # dictionary coverage
        share(r"(?i)[bcdfghjklmnpqrstvwxyz]{4}"),
        flag(value.rlike("^(?:" + _KNOWN + ")$")), flag(value.startswith("-----BEGIN ")),
        F.regexp_count(value, F.lit("/")).cast("double"), flag(before.rlike(r"[./~]$") | after.rlike(r"^[./][A-Za-z]")),  # path
        flag(near.rlike(r"://[^\s/@:]{0,64}:$") & after.startswith("@")),
        flag(near.rlike(r"(secret|token|passw|passphrase|passcode|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)[^\n]{0,12}$")),
        flag(near.rlike(r"(commit|sha|md5|hash|checksum|digest|uuid|guid|revision|etag|order|invoice|ticket|isbn|image|href|url|path|file|card|phone)[^\n]{0,16}$")),
        flag(near.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike(r"[\"']$")),
        flag(value.rlike(r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|0000000|1234567|test|your")),
        flag(value.rlike(r"[(){}\[\]$<%]|\*\*|^[A-Za-z_]+\.[A-Za-z_.]+$")),  # code, templates, masks
    ]


def labelled_findings(spark: SparkSession, rows: int = 9000, seed: int = 21) -> DataFrame:
    """Labelled findings (before, value, after, label) to train on, made up from `seed`.

    Half are secrets: key ids, hexadecimal and base-64 tokens and passwords (short ones, of letters only, with marks)
    after telling words, passwords in urls, private keys, bare tokens of known form. The others are what scanners report
    wrongly: digests of commits, UUIDs, paths, identifiers of dictionary words, long numbers, encoded images,
    placeholders, and words, phrases, names, calls and templates that are assigned to telling words. Callers with
    findings of their own pass those instead.
    """
    rng = random.Random(seed)
    some = lambda alphabet, low, high: "".join(rng.choices(alphabet, k=rng.randint(low, high)))
    pick = lambda *items: rng.choice(items)
    hexadecimal, letters, digits, upper = "0123456789abcdef", string.ascii_letters, string.digits, string.ascii_uppercase
    base64 = letters + digits + "+/"
    word = lambda: rng.choice(DICTIONARY)

    def spoken() -> str:
        return pick(str.lower, str.title)(word()) + pick("", "_", "-", "!", "@") + some(digits, 1, 5) + pick("", "!", word())

    def marked() -> str:
        return some(letters, 2, 8) + pick(*"!@#$%&?-_^", "") + some(base64, 3, 10) + pick("", "!", "1", "99", "#")

    def secret() -> tuple[str, str, str]:
        """(before, value, after); before is None where a telling word is assigned."""
        kind = rng.randrange(11)
        if kind == 0:
            return None, some(pick(hexadecimal, hexadecimal.upper()), 16, 64), ""
        if kind == 1:
            return None, some(base64, 16, 60), ""
        if kind == 2:
            return pick("", "key ", "aws_access_key_id=", "id "), pick("AKIA", "ASIA") + some(upper + "234567", 16, 16), pick(" and", ".", "")
        if kind == 3:
            return pick("", "token: ", "use "), pick("ghp_", "gho_", "sk_live_") + some(letters + digits, 24, 38), pick(" ", ".", "")
        if kind == 4:
            return None, some(letters, 12, 32), ""
        if kind in (5, 6):
            return None, marked(), ""
        if kind in (7, 8):
            return None, spoken(), ""
        if kind == 9:
            return pick("https", "postgres", "mysql", "ftp", "amqp") + "://" + word() + ":", pick(marked, spoken)(), "@host.example"
        if rng.random() < 0.5:
            return pick("Authorization: Bearer ", "bearer "), some(base64, 20, 44), pick(" ", "")
        return "", pick("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----") + pick("", "\n" + some(base64, 60, 200) + "\n-----END PRIVATE KEY-----"), pick(" ", "\n")

    def clean() -> tuple[str, str, str]:
        kind = rng.randrange(13)
        if kind == 0:
            return pick("commit ", "sha1: ", "md5 ", "checksum=", "digest: ", "hash ", "revision "), some(hexadecimal, 32, 32) + pick("", some(hexadecimal, 8, 8)), pick(" ", ".", "")
        if kind == 1:
            return pick("uuid ", "id ", "guid=", "request ", ""), "-".join(some(hexadecimal, n, n) for n in (8, 4, 4, 4, 12)), pick(" ", ".", "")
        if kind == 2:
            return pick("", ".", "path ", "file: ", "~"), f"/{word()}/{word()}{some(digits, 1, 2)}/{word()}-2{word()}", pick(".txt", ".py", " ", "/")
        if kind == 3:
            return pick("", "class ", "token ", "key: ", "name = "), f"{word()}_{word()}_{word()}{some(digits, 1, 4)}", pick(" ", ".", "")
        if kind in (4, 5):
            return pick("card ", "order ", "", "invoice ", "phone ", "isbn "), some(digits, 16, 24), pick(" ", ".", "")
        if kind == 6:
            return pick("data:image/png;base64,", "src=", "image ", "href="), some(base64, 60, 120), pick('"', " ", ")")
        if kind == 7:
            return None, pick("your_", "example_", "test_", "dummy-", "sample_", "xxxx", "placeholder_") + word() + "_" + word() + pick("_1234567", "_000000000", "_0123", "xxxx1", ""), ""
        if kind == 8:
            return None, word() + pick("", "s", "ed", "ing", "_name", " ") + pick("", word()), ""
        if kind == 9:
            return None, pick(*ASSIGNED), ""
        if kind == 10:
            return None, pick("get_", "os.environ[", "self.", "config.", "request.", "settings.", "load_", "process.env.", "args.", "data.") + word() + pick("()", "", "_token", "]", "(x)", ".value"), ""
        if kind == 11:
            return None, pick(*[a + word() + b for a, b in (("${", "}"), ("{{", "}}"), ("<", ">"), ("%(", ")s"), ("$(", ")"))], "********", "xxxxxxxx", "changeme", "[REDACTED]", "<password>", "None,None", "null,null", "........", "--------"), ""
        return pick("http", "https") + "://" + word() + ":", pick("8080", "443", "9200", "3306") + pick("", "?to=user"), "@host.example"

    made = []
    for k in range(rows):
        before, value, after = secret() if k % 2 else clean()
        filler = pick("the value of this is ", "and then ", "see below ", "", "in the text ", "of the and ", "it was ")
        if before is None:
            sign = pick("=", " = ", ": ", ' = "', '="', ": '", ":", '": "')
            before = pick("token", "password", "secret", "api_key", "access_key", "auth", "PASSWORD", "client_secret", "private_key", "passwd", "pwd", "db_password") + sign
            after = (sign[-1] if sign[-1] in "\"'" else "") + pick(" and more", "\n", " the", "", ".", " in")
        made.append({"before": (filler + before)[-BEFORE:], "value": value, "after": after[:AFTER], "label": k % 2})
    table = F.from_json(F.lit(json.dumps(made)), "array<struct<before:string,value:string,after:string,label:int>>")
    return spark.range(1).select(F.explode(table).alias("f")).select("f.*")


def train(findings: DataFrame, *, trees: int = 24, depth: int = 6, sample: int = 20_000, seed: int = 7) -> list[dict]:
    """The forest's trees, from at most `sample` labelled findings (those whose hashes are lowest)."""
    given = findings.select(F.xxhash64("before", "value", "after").alias("h"), "before", "value", "after", F.col("label").cast("double").alias("y"))
    rows = lowest(given, sample, ["h", "before", "value", "after", "y"]).repartition(8, "h").select(F.array(*features(F.col("value"), F.col("before"), F.col("after"))).alias("x"), "y", "h").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.x, r.y))
    return forest(np.array([r.x for r in rows], float), np.array([r.y for r in rows]), trees, depth, 5, seed)


def judged(found: Column, trees: list[dict], threshold: float = 0.5) -> Column:
    """array<struct<lead, start, value, score, is_secret>> of the candidates of parsed()."""

    def of(c: Column) -> Column:
        inputs = features(c["value"], c["before"], c["after"])

        def rated(x: Column) -> Column:
            score = reduce(lambda a, b: a + b, [tree_column(t, [F.element_at(x, k + 1) for k in range(len(inputs))]) for t in trees]) / len(trees)
            return let(score, lambda s: F.struct(c["lead"].alias("lead"), c["start"].alias("start"), c["value"].alias("value"), s.alias("score"), (s >= threshold).alias("is_secret")))

        return let(F.array(*inputs), rated)

    return F.transform(found, of)


def scan(docs: DataFrame, findings: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret): one row per candidate of every whole text.

    start counts characters from 0. score is the forest's share of votes for a secret; `threshold` itself is one. Null
    and empty texts have no candidates; candidates never overlap, the leftmost and longest form counts; rows with a null
    id keep it; repeated rows repeat their findings; an empty table gives no rows; other columns are not read.
    """
    trees = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    source = docs.select(F.col(id_col).alias("doc_id"), judged(parsed(F.col(text_col))["found"], trees, threshold).alias("found"))
    return source.select("doc_id", F.explode_outer("found").alias("f")).filter("f is not null").select("doc_id", "f.start", F.length("f.value").alias("length"), "f.value", "f.score", "f.is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, *, text_col: str = "text", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every secret in the text replaced by `mark`; texts without secrets, null included, are unchanged."""
    trees = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    body = F.col(text_col)

    def replaced(p: Column) -> Column:
        def joined(found: Column) -> Column:
            parts = F.transform(found, lambda f: F.concat(f["lead"], F.when(f["is_secret"], F.lit(mark)).otherwise(f["value"])))
            return F.when(F.exists(found, lambda f: f["is_secret"]), F.concat(F.array_join(parts, ""), p["rest"])).otherwise(body)

        return let(judged(p["found"], trees, threshold), joined)

    return docs.withColumn(text_col, let(parsed(body), replaced))
